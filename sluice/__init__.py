"""Working copies of large partitioned tables: select, sample, copy, register, track, clean up."""
