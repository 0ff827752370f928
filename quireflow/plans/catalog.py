"""Every registered query with its DuckDB SQL, by name."""

from quireflow.plans import corpus, fidelity, forensics, intake, library, scoring, searching, streams  # noqa: F401
from quireflow.plans.registry import ORACLE, QUERIES  # noqa: F401
