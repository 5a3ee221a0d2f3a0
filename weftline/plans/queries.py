"""All queries over the driver tables, each through the operators it is named for, and their SQL twins."""

from __future__ import annotations

from weftline.plans import lengths, records, scenes, stored

QUERIES = lengths.QUERIES | scenes.QUERIES | records.QUERIES | stored.QUERIES
ORACLE = lengths.ORACLE | scenes.ORACLE | records.ORACLE | stored.ORACLE

flagship = lengths.flagship
