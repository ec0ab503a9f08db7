"""Packet-assembly analytics: document packets resolved as Spark tables."""
