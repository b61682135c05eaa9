"""Models from outside of Spark over the arrays of sequence samples."""
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pluvia.registry import Registry

CELLS = 1 << 20   # numbers that a model gets at once
EXTERNAL = Registry("external model")   # () -> (numpy array [rows, steps, features] -> numpy array [rows])


@EXTERNAL.add("persistence")
def persistence() -> Callable[[np.ndarray], np.ndarray]:
    """The last step's precipitation, the last of the features."""
    return lambda x: x[:, -1, -1]


def predict(samples: DataFrame, make: Callable, steps: int, features: int, non_negative: bool = False, cells: int = CELLS) -> DataFrame:
    """samples (data: steps x features, ...) with pred in place of data. make() gives the model, once in each Python worker;
    it is called with as many rows as hold `cells` numbers at most, and with one at least."""
    def load():
        model = make()
        return lambda data: np.asarray(model(data), dtype=np.float64).reshape(len(data))
    udf = predict_batch_udf(load, return_type=DoubleType(), batch_size=max(1, cells // (steps * features)), input_tensor_shapes=[[steps, features]])
    pred = udf(F.flatten("data"))
    return samples.withColumn("pred", F.greatest(pred, F.lit(0.0)) if non_negative else pred).drop("data")
