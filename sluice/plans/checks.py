"""Equivalent SQL of the registered queries, for an independent engine."""

from __future__ import annotations

from sluice.plans.registered import (
    EMPTY_MONTH,
    FIRST_DAYS_END,
    LOG_TIMES,
    NOW,
    REQUEST_TEXTS,
    long_specs,
)

EVENTS = "(SELECT *, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H') AS hour FROM events)"
LINES = (
    "(SELECT *, strftime(l_shipdate, '%Y') AS ship_year, strftime(l_shipdate, '%m') AS ship_month FROM lineitem)"
)
ORDERS = "(SELECT *, strftime(o_orderdate, '%Y-%m') AS order_month FROM orders)"

EVENT_NAME = "'day=' || day || '/hour=' || hour"
LINE_NAME = "'ship_year=' || ship_year || '/ship_month=' || ship_month"
ORDER_NAME = "'order_month=' || order_month"

EVENT_PARTS = f"(SELECT day, hour, {EVENT_NAME} AS name, count(*) AS row_count FROM {EVENTS} GROUP BY ALL)"
LINE_PARTS = (
    f"(SELECT ship_year, ship_month, {LINE_NAME} AS name, count(*) AS row_count FROM {LINES} GROUP BY ALL)"
)
ORDER_PARTS = f"(SELECT order_month, {ORDER_NAME} AS name, count(*) AS row_count FROM {ORDERS} GROUP BY ALL)"

LINE_OUT = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, ship_year, ship_month"
LINE_FILTER = (
    "((ship_year = '1996' AND ship_month = '03') OR ship_year = '1997' "
    "OR (ship_year = '1998' AND ship_month = '11'))"
)


def _sampled(p: str, *keys: str) -> str:
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    limit = f"lpad(lower(to_hex(CAST(floor(({p}) * 4294967296) AS BIGINT))), 8, '0')"
    return f"substring(md5(concat_ws('|', {text})), 1, 8) < {limit}"


LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

# Columns per table by kind, to compute logical bytes.
_WIDTHS: dict[str, tuple[dict[str, int], list[str]]] = {
    "region": ({"r_regionkey": 4}, ["r_name"]),
    "nation": ({"n_nationkey": 4, "n_regionkey": 4}, ["n_name"]),
    "customer": ({"c_custkey": 8, "c_nationkey": 4, "c_acctbal": 8}, ["c_name", "c_mktsegment"]),
    "supplier": ({"s_suppkey": 8, "s_nationkey": 4, "s_acctbal": 8}, ["s_name"]),
    "part": ({"p_partkey": 8, "p_size": 4, "p_retailprice": 8}, ["p_name", "p_brand", "p_type"]),
    "orders": (
        {"o_orderkey": 8, "o_custkey": 8, "o_totalprice": 8, "o_orderdate": 8},
        ["o_orderstatus", "o_orderpriority"],
    ),
    "lineitem": (
        {
            "l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8,
            "l_extendedprice": 8, "l_discount": 8, "l_tax": 8, "l_shipdate": 8,
        },
        ["l_returnflag", "l_linestatus"],
    ),
    "events": ({"event_id": 8, "ts": 8, "user_id": 8, "value": 8}, ["event_type", "props"]),
    "documents": ({"doc_id": 8, "n_chars": 8}, ["text", "lang", "source"]),
    "embeddings": ({"vec_id": 8, "label": 4}, []),
    "pages": ({"page_id": 8}, ["url", "html"]),
    "benchmark": ({"item_id": 8}, ["text"]),
    "labels": ({"doc_id": 8, "quality": 4, "toxic": 4}, []),
    "conversations": ({"conv_id": 8, "turn": 8}, ["role", "text"]),
}


def _bytes(name: str, label_widths: dict[str, dict[str, int]] | None = None) -> str:
    fixed, texts = _WIDTHS[name]
    terms = [f"{w} * count({c})" for c, w in fixed.items()]
    terms += [f"coalesce(sum(strlen({c})), 0)" for c in texts]
    if name == "embeddings":
        terms.append("coalesce(sum(4 * len(embedding)), 0)")
    return f"CAST({' + '.join(terms)} AS BIGINT)"


def _summary() -> str:
    rows = []
    counted = {"events": EVENT_PARTS, "lineitem": LINE_PARTS, "orders": ORDER_PARTS}
    for name in _WIDTHS:
        parts = f"(SELECT count(*) FROM {counted[name]})" if name in counted else "0"
        files = parts if name in counted else "1"
        rows.append(
            f"SELECT '{name}' AS name, {_bytes(name)} AS bytes, CAST({files} AS BIGINT) AS files, "
            f"CAST({parts} AS BIGINT) AS partitions, CAST(NULL AS VARCHAR) AS error FROM {name}"
        )
    rows.append("SELECT 'returns', NULL, NULL, NULL, 'table not found: returns'")
    return "(" + " UNION ALL ".join(rows) + ")"


def _specs_values(specs: list[dict[str, str]]) -> str:
    def text(value):
        return "NULL" if value is None else f"'{value}'"

    rows = ", ".join(
        f"({i}, {text(s.get('day'))}, {text(s.get('hour'))})" for i, s in enumerate(specs)
    )
    return f"(SELECT * FROM (VALUES {rows}) v(spec_id, spec_day, spec_hour))"


def _per_spec(specs: list[dict[str, str]], cap: int) -> str:
    return f"""
        SELECT DISTINCT name, row_count FROM (
          SELECT p.name, p.row_count,
                 row_number() OVER (PARTITION BY s.spec_id ORDER BY p.name DESC) AS r
          FROM {EVENT_PARTS} p JOIN {_specs_values(specs)} s
            ON (s.spec_day IS NULL OR s.spec_day = p.day) AND (s.spec_hour IS NULL OR s.spec_hour = p.hour)
        ) WHERE r <= {cap}"""


_MULTI = [
    {"day": "2024-01-05"},
    {"day": "2024-01-28"},
    {"hour": "13"},
    {"day": "2024-01-05", "hour": "07"},
]


def _policy(threshold: int, default_size: str) -> str:
    requests = """(SELECT * FROM (VALUES
        ('lineitem', 0.02::DOUBLE, NULL::BIGINT, NULL::INTEGER, false),
        ('orders', 0.5, 25000, NULL, true),
        ('events', NULL, NULL, 3, false),
        ('documents', 1.0, NULL, NULL, false),
        ('customer', NULL, 10000000000, NULL, false),
        ('region', 0.5, NULL, NULL, false),
        ('returns', 0.5, NULL, NULL, false)) r(name, prob, size, cap, skip_cleanup))"""
    return f"""
        SELECT name, bytes, probability,
               CASE WHEN error IS NOT NULL THEN NULL
                    WHEN probability >= 1 OR bytes <= {threshold} THEN 'full' ELSE 'sample' END AS mode,
               partition_count, skip_cleanup, error
        FROM (
          SELECT r.name, s.bytes,
                 CASE WHEN s.error IS NULL THEN
                   coalesce(CAST(r.size AS DOUBLE) / s.bytes, r.prob,
                            CAST({default_size} AS DOUBLE) / s.bytes, 0.01::DOUBLE) END AS probability,
                 CAST(coalesce(r.cap, -1) AS INTEGER) AS partition_count, r.skip_cleanup, s.error
          FROM {requests} r LEFT JOIN {_summary()} s ON r.name = s.name)"""


def _arrival(column: str = "day") -> str:
    return f"CASE WHEN {column} <= '{FIRST_DAYS_END}' THEN 'first' ELSE 'second' END"


_LEDGER = f"""(SELECT name, day, hour, row_count,
    CASE WHEN substring(md5(name), 1, 1) < '8' THEN 'finished'
         WHEN substring(md5(name), 1, 1) < 'b' THEN 'failed'
         WHEN substring(md5(name), 1, 1) < 'd' THEN 'invalid' ELSE 'todo' END AS state
    FROM {EVENT_PARTS})"""


def _elapsed(seconds: str) -> str:
    return (
        f"printf('%d:%02d:%02d', {seconds} // 3600, ({seconds} % 3600) // 60, {seconds} % 60)"
    )


def _readable(moment: str) -> str:
    return f"strftime({moment}, '%d/%b/%Y %H:%M:%S')"


def _log_time(name: str) -> str:
    return _readable(f"TIMESTAMP '{LOG_TIMES[name]}'")


_EVENT_TYPES = (
    "`event_id` bigint, `ts` timestamp_ntz, `user_id` bigint, `event_type` string, "
    "`value` double, `props` string, `day` string, `hour` string"
)
_ORDER_TYPES = (
    "`o_orderkey` bigint, `o_custkey` bigint, `o_orderstatus` string, `o_totalprice` double, "
    "`o_orderdate` timestamp_ntz, `o_orderpriority` string, `order_month` string"
)

_EXPIRING = f"""(SELECT o_orderkey AS copy_id, o_orderstatus <> 'F' AS running,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 'junk'
         ELSE {_readable('o_orderdate')} END AS expires FROM orders)"""

_PARSED_EXPIRY = "try_strptime(expires, '%d/%b/%Y %H:%M:%S')"

_FORMATS = ("parquet", "orc", "json", "textfile", "delimited")

_LINE_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]


def _request(i: int, body: str) -> str:
    text = REQUEST_TEXTS[i].replace("'", "''")
    return body.replace("$REQUEST", f"'{text}'")


def statements() -> dict[str, str]:
    """SQL per query name; queries that SQL cannot express are left out."""
    sql: dict[str, str] = {}
    sql["list_partitions"] = f"SELECT name, row_count FROM {EVENT_PARTS}"
    sql["catalog_partitions"] = (
        f"SELECT ship_year, ship_month, name, true AS has_bytes FROM {LINE_PARTS} WHERE ship_year = '1997'"
    )
    sql["last_n_partitions"] = f"SELECT name, row_count FROM {EVENT_PARTS} ORDER BY name DESC LIMIT 48"
    sql["last_n_top_level"] = f"""SELECT name, row_count FROM (
        SELECT name, row_count, dense_rank() OVER (ORDER BY day DESC) AS r FROM {EVENT_PARTS}) WHERE r <= 7"""
    sql["multi_spec_partitions"] = _per_spec(_MULTI, 5)
    sql["multi_spec_partitions_long"] = _per_spec(long_specs(), 10)
    sql["resolve_requests"] = " UNION ALL ".join(
        [
            _request(0, f"""SELECT $REQUEST AS request, name, CAST(NULL AS VARCHAR) AS error
                FROM {EVENT_PARTS} WHERE day = '2024-01-05' OR (day = '2024-01-06' AND hour = '10')"""),
            _request(1, f"SELECT $REQUEST, name, NULL FROM {ORDER_PARTS} WHERE order_month = '1995-03'"),
            _request(2, "SELECT $REQUEST, NULL, 'spec has no partition: order_month=1890-01'"),
            _request(3, f"""SELECT $REQUEST, name, NULL FROM {LINE_PARTS}
                WHERE ship_year = '1996' AND ship_month = '02'"""),
            _request(4, "SELECT $REQUEST, NULL, 'table not found: returns'"),
            _request(5, "SELECT $REQUEST, NULL, 'cannot read request'"),
        ]
    )
    sql["partition_filter_scan"] = f"SELECT {LINE_OUT} FROM {LINES} WHERE {LINE_FILTER}"
    before_noon = "(hour < '12' OR day IN ('2024-01-09', '2024-01-10'))"
    sql["partition_filter_join"] = (
        f"SELECT event_id, day, hour FROM {EVENTS} WHERE day BETWEEN '2024-01-01' AND '2024-01-30' AND {before_noon}"
    )
    sql["partition_range_scan"] = sql["partition_filter_join"]
    sql["partition_filter_folders"] = sql["partition_filter_scan"]
    sql["partition_semi_join"] = f"""SELECT {LINE_OUT} FROM {LINES} WHERE {LINE_NAME} IN (
        SELECT name FROM {LINE_PARTS} ORDER BY name DESC LIMIT 24)"""

    sql["source_summary"] = f"SELECT * FROM {_summary()}"
    sql["footer_sizes"] = f"""SELECT name, row_count, (SELECT count(*) FROM lineitem) AS all_rows, true AS adds_up
        FROM {LINE_PARTS}"""
    sql["source_totals"] = f"""SELECT count(*) FILTER (error IS NULL) AS valid,
        count(*) FILTER (error IS NOT NULL) AS invalid, CAST(sum(bytes) AS BIGINT) AS bytes FROM {_summary()}"""
    line_bytes = f"strlen(concat_ws('|', {', '.join(LINE_KEYS)}, l_returnflag, l_linestatus)) + 1"
    sql["partition_bytes"] = (
        f"SELECT {LINE_NAME} AS name, CAST(sum({line_bytes}) AS BIGINT) AS bytes, true AS below_table "
        f"FROM {LINES} GROUP BY ALL"
    )
    sql["source_summary_folders"] = f"""SELECT 'lineitem' AS name, CAST(sum({line_bytes}) AS BIGINT) AS bytes,
        count(DISTINCT {LINE_NAME}) AS files, count(DISTINCT {LINE_NAME}) AS partitions,
        CAST(NULL AS VARCHAR) AS error FROM {LINES}"""

    sql["sample_policy"] = _policy(20_000, "NULL")
    sql["sample_policy_size_default"] = _policy(0, "30000")
    line_sample = _sampled("0.1", *LINE_KEYS)
    sql["bernoulli_sample"] = (
        f"SELECT {', '.join(LINE_KEYS)}, l_quantity FROM lineitem WHERE {line_sample}"
    )
    sql["bernoulli_sample_band"] = f"""SELECT ship_year, count(*) AS row_count, true AS md5_in_band,
        true AS xxhash64_in_band, true AS rand_in_band FROM {LINES} GROUP BY ALL"""
    sql["bernoulli_sample_rand"] = f"""SELECT ship_year, count(*) AS row_count, CAST(0 AS BIGINT) AS too_many,
        true AS in_band FROM {LINES} GROUP BY ALL"""
    share = f"100000 / (SELECT CAST({_bytes('lineitem')} AS DOUBLE) FROM {LINES} WHERE ship_year = '1997')"
    sql["size_target_sample"] = f"""SELECT {LINE_OUT} FROM {LINES} WHERE ship_year = '1997'
        AND (({share}) >= 1 OR {_sampled(f'least({share}, 0.5)', *LINE_KEYS)})"""

    sql["sample_copy"] = f"SELECT {LINE_OUT} FROM {LINES} WHERE {LINE_FILTER} AND {line_sample}"
    sql["surviving_partitions"] = f"""SELECT {EVENT_NAME} AS name, count(*) AS row_count FROM {EVENTS}
        WHERE {_sampled('0.005', 'event_id')} GROUP BY ALL"""
    sql["full_copy"] = f"""SELECT order_month, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS keys
        FROM {ORDERS} GROUP BY ALL UNION ALL SELECT '{EMPTY_MONTH}', 0, NULL"""
    sql["full_copy_bytes"] = f"""SELECT name, row_count FROM (
        SELECT name, row_count FROM {ORDER_PARTS} ORDER BY name DESC LIMIT 23)
        UNION ALL SELECT 'order_month={EMPTY_MONTH}', 0"""
    sql["copy_files"] = f"""SELECT ship_year, ship_month, count(*) AS row_count,
        CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS incomplete_files FROM {LINES} GROUP BY ALL"""
    sql["copy_files_report"] = " UNION ALL ".join(
        f"SELECT '{name}.parquet' AS file, '{name}.parquet' AS copy, true AS has_bytes, true AS complete"
        for name in _WIDTHS
    )
    sql["copy_files_ranges"] = " UNION ALL ".join(f"SELECT '{name}' AS file, true AS same_sum" for name in _WIDTHS)
    sql["copy_loose_files"] = f"SELECT order_month, true AS logged FROM {ORDER_PARTS}"
    sql["two_hop_copy"] = f"""SELECT order_month, count(*) AS row_count,
        CAST(sum(o_orderkey) AS BIGINT) AS keys FROM {ORDERS} GROUP BY ALL"""
    event_sample = _sampled("0.1", "event_id")
    sql["incremental_copy"] = f"""SELECT event_id, day, hour, {_arrival()} AS arrived
        FROM {EVENTS} WHERE {_sampled('0.03', 'event_id')}"""
    sql["stream_incremental_copy"] = f"SELECT event_id, day FROM {EVENTS} WHERE {event_sample}"
    sql["stream_registered_copy"] = f"SELECT o_orderkey, order_month FROM {ORDERS} WHERE {_sampled('0.3', 'o_orderkey')}"
    sql["stream_late_files"] = f"SELECT event_id, day FROM {EVENTS}"
    sql["rerun_sample_then_full"] = f"SELECT day, hour, row_count, 'full' AS mode FROM {EVENT_PARTS}"
    sql["rerun_with_hook"] = f"""SELECT event_id, '#' AS event_type, day, hour FROM {EVENTS}
        WHERE {_sampled('0.5', 'event_id')}"""
    sql["rerun_adds_nothing"] = f"""SELECT day, hour, count(*) AS row_count,
        (SELECT count(*) FROM {EVENT_PARTS}) AS taken_in, CAST(0 AS BIGINT) AS added
        FROM {EVENTS} WHERE {_sampled('0.03', 'event_id')} GROUP BY ALL"""
    sql["rerun_changed_partition"] = f"""SELECT day, hour, row_count * (CASE WHEN day = '2024-01-15' THEN 2 ELSE 1 END)
        AS row_count, CASE WHEN day = '2024-01-15' THEN 'changed' ELSE '' END AS change FROM {EVENT_PARTS}"""
    sql["rerun_new_hook"] = f"""SELECT event_id, '#' AS event_type, day, hour FROM {EVENTS}
        WHERE {_sampled('0.3', 'event_id')}"""
    sql["overlapping_runs"] = f"""SELECT event_id, day, hour, 'LeaseHeld' AS refused FROM {EVENTS}
        WHERE {_sampled('0.3', 'event_id')}"""
    sql["rerun_new_column"] = f"""SELECT event_id, CASE WHEN day >= '2024-01-15' THEN event_type END AS event_type,
        day, hour FROM {EVENTS}"""
    sql["rerun_byte_copy"] = f"""SELECT day, hour, row_count * (CASE WHEN day = '2024-01-03' THEN 2 ELSE 1 END)
        AS row_count, CAST(0 AS BIGINT) AS odd_files FROM {EVENT_PARTS}"""
    sql["moved_partition"] = (
        f"SELECT order_month, row_count, true AS has_bytes, true AS folder_gone FROM {ORDER_PARTS}"
    )
    sql["copy_run_two_databases"] = """
        SELECT 'orders' AS name, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders
        UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer"""
    sql["copy_local_attach"] = f"""SELECT name, row_count, true AS is_local FROM {LINE_PARTS}
        UNION ALL SELECT name, row_count, true FROM {ORDER_PARTS}"""
    sql["staged_publish"] = f"""SELECT 'day=' || day AS name, count(*) AS row_count,
        CAST(0 AS BIGINT) AS staged_files FROM {EVENTS} WHERE {event_sample} GROUP BY ALL"""
    sql["sweep_leftovers"] = f"""SELECT *, CAST(0 AS BIGINT) AS left_over,
            (SELECT count(*) + 1 FROM {EVENT_PARTS} WHERE day = '2024-01-05') AS restored
        FROM (SELECT 'events' AS copy, name, row_count FROM {EVENT_PARTS}
              UNION ALL SELECT 'orders', name, row_count FROM {ORDER_PARTS})"""
    sql["copy_with_hooks"] = f"""SELECT c_custkey, regexp_replace(c_name, '[0-9]', '#', 'g') AS c_name,
        c_mktsegment, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS side_lines
        FROM customer WHERE {_sampled('0.5', 'c_custkey')}"""
    sql["format_roundtrip"] = " UNION ALL ".join(
        f"SELECT *, '{kind}' AS stored_as FROM part" for kind in _FORMATS
    )
    sql["text_lines_roundtrip"] = "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents"
    sql["nested_text_roundtrip"] = "SELECT event_id, event_type, props ->> 'k' AS k FROM events"

    sql["schema_clone"] = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS name, '{t}' AS type, true AS nullable, "
        f"count({c}) AS filled FROM lineitem"
        for i, (c, t) in enumerate(_LINE_TYPES)
    )
    sql["copy_log"] = f"""
        SELECT 'tester' AS writer, {_log_time('events')} AS written, 'hive' AS data_type, name AS item,
          'alter table `events` add if not exists partition (`day`=''' || day || ''', `hour`=''' || hour || ''') ' AS line
        FROM {EVENT_PARTS}
        UNION ALL SELECT 'tester', {_log_time('events')}, 'hive', '',
          'CREATE TABLE IF NOT EXISTS `events` ({_EVENT_TYPES}) USING parquet PARTITIONED BY (`day`, `hour`) '
        UNION ALL SELECT 'tester', {_log_time('orders')}, 'hive', name,
          'alter table `orders` add if not exists partition (`order_month`=''' || order_month || ''') '
        FROM {ORDER_PARTS}
        UNION ALL SELECT 'tester', {_log_time('orders')}, 'hive', '',
          'CREATE TABLE IF NOT EXISTS `orders` ({_ORDER_TYPES}) USING parquet PARTITIONED BY (`order_month`) '
        UNION ALL SELECT 'tester', {_log_time('files')}, 'hdfs', name || '/rows.parquet',
          's3a://shared/loose/' || name || '/rows.parquet'
        FROM {LINE_PARTS}"""
    sql["compacted_log"] = sql["copy_log"]
    sql["attach"] = (
        f"SELECT name, row_count FROM {LINE_PARTS} UNION ALL SELECT name, row_count FROM {ORDER_PARTS}"
    )
    sql["partition_count_query"] = f"""SELECT day, hour, count(*) AS row_count FROM {EVENTS}
        WHERE {_sampled('0.5', 'event_id')} AND day >= '2024-01-29' AND {EVENT_NAME} IN (
          SELECT name FROM {EVENT_PARTS} ORDER BY name DESC LIMIT 48) GROUP BY ALL"""
    sql["cleanup"] = f"""
        SELECT 'lineitem' AS copy, name, row_count, true AS plain_copy_gone FROM {LINE_PARTS}
        WHERE name NOT IN (SELECT name FROM {LINE_PARTS} ORDER BY name DESC LIMIT 12)
        UNION ALL SELECT 'orders', name, row_count, true FROM {ORDER_PARTS}"""

    sql["copy_report"] = f"""SELECT state, items, seconds, {_elapsed('seconds')} AS elapsed FROM (
        SELECT state, count(*) AS items, CAST(sum(row_count * 60) AS BIGINT) AS seconds
        FROM {_LEDGER} GROUP BY state)"""
    sql["run_totals"] = f"""SELECT *, {_elapsed('seconds')} AS elapsed FROM (
        SELECT count(*) FILTER (state = 'finished') AS success, count(*) FILTER (state = 'failed') AS failure,
               count(*) FILTER (state = 'invalid') AS invalid, CAST(sum(row_count * 60) AS BIGINT) AS seconds
        FROM {_LEDGER})"""
    sql["bucketed_copy"] = f"""SELECT o_orderkey, count(*) AS row_count, CAST(sum(l_linenumber) AS BIGINT) AS numbers
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE {_sampled('0.3', *LINE_KEYS)} GROUP BY ALL"""
    sql["compacted_ledger"] = f"SELECT name AS item, state, CAST(row_count * 60 AS BIGINT) AS seconds FROM {_LEDGER}"
    sql["resume_ledger"] = f"""
        WITH wanted AS (
          SELECT name AS item FROM {EVENT_PARTS} WHERE substring(md5(reverse(name)), 1, 1) < 'c'
          UNION SELECT name FROM {ORDER_PARTS}),
        known AS (SELECT name AS item, state FROM {_LEDGER})
        SELECT item, coalesce(state, 'new') AS before,
               CASE WHEN state IN ('finished', 'invalid') THEN state ELSE 'todo' END AS state,
               coalesce(state NOT IN ('finished', 'invalid'), true) AS attempt
        FROM wanted FULL JOIN known USING (item)
        WHERE state IN ('finished', 'invalid') OR item IN (SELECT item FROM wanted)"""

    below = "name || '/rows.parquet'"
    sql["path_functions"] = f"""SELECT name,
        '/lake/lineitem/' || {below} AS relative,
        'hdfs://primary:8020/lake/lineitem/' || name AS parent,
        '$LOCATION/lake/lineitem/' || {below} AS variable,
        's3a://shared/lake/lineitem/' || {below} AS resolved,
        's3a://shared/lake/lineitem/' || {below} AS uri,
        {below} AS below,
        'lineitem/' || {below} AS below_with_base,
        true AS is_below,
        'ship_year=' || ship_year || ', ship_month=''' || ship_month || '''' AS spec,
        'ship_year=' || ship_year || ' and ship_month=''' || ship_month || '''' AS filter,
        '(ship_year, ship_month)' AS columns,
        ship_month AS month,
        'ship_year+ship_month' AS items
        FROM {LINE_PARTS}"""
    sql["common_location"] = f"""SELECT '/lake/lineitem/ship_year=' || ship_year AS folder,
        count(*) AS locations FROM {LINE_PARTS} GROUP BY ship_year"""
    second = "date_trunc('second', ts)"
    sql["time_texts"] = f"""SELECT event_id, strftime({second}, '%Y-%b-%d-%H-%M-%S') AS sortable,
        {_readable(second)} AS readable, {_readable(second)} AS from_millis FROM events"""
    sql["first_level_dirs"] = f"""SELECT DISTINCT '/lake/lineitem/ship_year=' || ship_year AS folder
        FROM {LINES} WHERE ship_year LIKE '199%'"""

    sql["parent_child_rollup"] = """
        WITH known AS (SELECT 'orders' AS of, c_custkey AS parent, true AS known FROM customer
                       UNION ALL SELECT 'documents', doc_id, true FROM labels),
        reduced AS (SELECT 'orders' AS of, o_custkey AS parent, count(*) AS n, count(DISTINCT o_orderkey) AS members,
                    min(o_orderkey) AS first_child, max(o_orderkey) AS last_child FROM orders GROUP BY ALL
                    UNION ALL SELECT 'documents', doc_id, count(*), count(DISTINCT n_chars), min(n_chars), max(n_chars)
                    FROM documents GROUP BY ALL)
        SELECT of, parent, CASE WHEN known IS NULL THEN 'orphan' WHEN n IS NULL THEN 'childless'
               ELSE 'matched' END AS kind,
               coalesce(n, 0) AS children, coalesce(members, 0) AS members, first_child, last_child
        FROM known FULL JOIN reduced USING (of, parent)"""
    sql["parent_child_members"] = """
        SELECT DISTINCT l_orderkey AS parent, l_partkey AS child FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""
    sql["orphans"] = """SELECT conv_id, turn, role FROM conversations
        WHERE conv_id NOT IN (SELECT doc_id FROM labels)"""
    sql["expired_copies"] = f"""SELECT copy_id, running, expires FROM {_EXPIRING}
        WHERE running AND coalesce({_PARSED_EXPIRY} < TIMESTAMP '{NOW}', true)"""
    extended = f"""(CASE WHEN expires IS NULL THEN TIMESTAMP '{NOW}' ELSE {_PARSED_EXPIRY} END
        + INTERVAL 3 DAY)"""
    allowed = f"{extended} <= TIMESTAMP '{NOW}' + INTERVAL 6 DAY"
    sql["extend_expiry"] = f"""SELECT copy_id,
        CASE WHEN {allowed} THEN {_readable(extended)} END AS extended,
        NOT coalesce({allowed}, false) AS refused,
        {_readable(f"(TIMESTAMP '{NOW}' + INTERVAL 3 DAY)")} AS reset
        FROM {_EXPIRING} WHERE running"""
    sql["tag_lookup"] = """SELECT event_id, CAST(user_id AS VARCHAR) AS owner FROM events
        WHERE json_extract_string(props, '$.k') = '69'"""
    sql["tag_edit"] = """SELECT event_id, '{"type":"' || event_type || '"}' AS user_tags,
        'seen' AS k, CAST(2 AS BIGINT) AS tag_count FROM events"""

    last_events = f"{EVENT_NAME} IN (SELECT name FROM {EVENT_PARTS} ORDER BY name DESC LIMIT 48)"
    last_orders = f"order_month IN (SELECT order_month FROM {ORDER_PARTS} ORDER BY order_month DESC LIMIT 12)"
    sql["copy_run"] = f"""
        SELECT 'lineitem' AS name, 'sample' AS mode, count(*) AS row_count FROM {LINES}
          WHERE ship_year IN ('1996', '1997') AND {line_sample}
        UNION ALL SELECT 'events', 'sample', count(*) FROM {EVENTS}
          WHERE {_sampled('0.5', 'event_id')} AND {last_events}
        UNION ALL SELECT 'orders', 'full', count(*) FROM {ORDERS} WHERE {last_orders}
        UNION ALL SELECT 'customer', 'sample', count(*) FROM customer WHERE {_sampled('0.2', 'c_custkey')}
        UNION ALL SELECT 'nation', 'full', count(*) FROM nation"""
    sql["copy_run_states"] = """SELECT * FROM (VALUES ('lineitem', 'finished'), ('events', 'finished'),
        ('orders', 'finished'), ('customer', 'finished'), ('nation', 'finished'), ('part', 'failed'),
        ('returns', 'invalid')) v(item, state)"""
    return sql
