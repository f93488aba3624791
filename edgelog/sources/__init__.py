"""Sources and sinks: driver tables, access-log tiers, event envelopes,
rule/catalog dimension tables and raw text logs."""
