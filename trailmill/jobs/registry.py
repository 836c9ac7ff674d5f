"""All registered jobs of the library proper, and their SQL."""

from __future__ import annotations

from trailmill.jobs import apps, chats, folders, samples, scores, stores, trajectories, worlds

QUERIES = chats.QUERIES | trajectories.QUERIES | scores.QUERIES | stores.QUERIES | worlds.QUERIES | samples.QUERIES | apps.QUERIES | folders.QUERIES
ORACLE_SQL = chats.ORACLE_SQL | trajectories.ORACLE_SQL | scores.ORACLE_SQL | stores.ORACLE_SQL | worlds.ORACLE_SQL | samples.ORACLE_SQL | apps.ORACLE_SQL | folders.ORACLE_SQL
