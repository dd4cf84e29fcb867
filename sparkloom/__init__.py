"""sparkloom: a Spark-native relational and corpus-processing engine.

Everything relational is expressed with DataFrames or Spark SQL, so Catalyst
and AQE own the physical plan.  The subpackage ``llm`` is optional: nothing
outside it imports it.
"""

from sparkloom.plans.engine import Engine, EngineError
from sparkloom.session import build_session

__all__ = ["Engine", "EngineError", "build_session"]
