"""All registered queries.  Importing the modules fills the registry."""

import importlib

from barlume.plans.registry import ORACLES, QUERIES

for _name in ("views", "q_market", "q_quality", "q_features", "q_labels", "q_rules", "q_trades", "q_models", "q_eval", "q_dep", "q_live"):
    importlib.import_module(f"barlume.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
