"""Driver-facing plans: each query reads the given tables and returns a
DataFrame; ``oracle`` holds the equivalent DuckDB SQL."""

from quarry.plans.queries import QUERIES  # noqa: F401
from quarry.plans.oracle import ORACLE_SQL  # noqa: F401
