"""sparkloom: log and event analytics expressed as Spark plans."""
