"""pyspark.ml transformers around the Column functions, for use in ML Pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.functions.preprocess import DEFAULT_PREPROCESSOR, preprocessor, preprocessor_name
from mailscreen.functions.stats import STATISTICS, with_email_stats
from mailscreen.functions.text import clean_text


class TextCleaner(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the cleaned text; `preprocess` may replace the cleaning by another Column function.

    A function that is registered (`functions.preprocess`) is saved by its name.
    """

    preprocessorName = Param(Params._dummy(), "preprocessorName", "name of the registered text function", TypeConverters.toString)

    def __init__(self, inputCol: str = "text", outputCol: str = "clean", preprocess: Callable[[str], Column] | str = clean_text):
        super().__init__()
        self._setDefault(preprocessorName=DEFAULT_PREPROCESSOR)
        self._set(inputCol=inputCol, outputCol=outputCol)
        name = preprocess if isinstance(preprocess, str) else preprocessor_name(preprocess)
        self._own = None
        if name is None:
            self._own = preprocess
        elif name != DEFAULT_PREPROCESSOR:
            self._set(preprocessorName=name)

    @property
    def preprocess(self) -> Callable[[str], Column]:
        return self._own or preprocessor(self.getOrDefault(self.preprocessorName))

    def write(self):
        """A function without a name would be lost on loading."""
        if self._own is not None:
            raise ValueError("register the preprocess function before saving a TextCleaner that uses it")
        return super().write()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.preprocess(self.getInputCol()))


class EmailStats(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the eleven statistics as one vector, in the order of `feature_names`."""

    feature_names = STATISTICS

    def __init__(self, inputCol: str = "text", outputCol: str = "email_stats"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stats = with_email_stats(dataset, self.getInputCol(), dataset.columns)
        vector = array_to_vector(F.array(*STATISTICS)).alias(self.getOutputCol())
        return stats.select(*dataset.columns, vector)
