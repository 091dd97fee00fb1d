"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from wayside.plans import registry, subsystems
from wayside.plans.inputs import GAP, event_stream

for _name in ("stream", "scores", "peers", "rail", "fatigue", "history", "models", "live", "answers"):
    import_module(f"wayside.plans.catalog_{_name}")


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)


def flagship(spark, sf):
    """Verdict for every cycle of every stream."""
    return subsystems.peer_verdicts(*subsystems.door_cycles(event_stream(spark, sf), GAP))
