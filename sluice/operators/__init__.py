"""Selection, sampling, copying, registration, ledger, cleanup and tag operators."""
