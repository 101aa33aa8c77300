"""Objects sent to the executors by value, so that these need no copy of this package."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from weirflow.llm.scratch import small_batches


class Sent:
    """A broadcast object; ``value`` is unpacked once in each task."""

    def __init__(self, packed: Any) -> None:
        self.packed = packed

    def __getstate__(self) -> dict:
        return {"packed": self.packed}

    @property
    def value(self) -> Any:
        if "held" not in self.__dict__:
            self.held = pickle.loads(self.packed.value)
        return self.held


def send(spark: SparkSession, value: Any) -> Sent:
    small_batches(spark)
    return Sent(spark.sparkContext.broadcast(cloudpickle.dumps(value)))
