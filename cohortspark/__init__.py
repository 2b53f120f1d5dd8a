"""Cohort and target-trial analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from cohortspark.config import StudyConfig
from cohortspark.session import get_session

# functions sent to Python workers carry their code along, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["StudyConfig", "get_session"]
