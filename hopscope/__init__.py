"""hopscope: network-capture and latency analytics expressed as Spark plans."""
