"""No streaming operators: the inventory has none.  Batch operators run unchanged inside ``foreachBatch``."""
