"""Flow-sequence analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from netseq.spec import CategoricalFormat, EvalSampling, FlowSpec, ModelInput, StudyParams

# Python functions sent to executors carry their own code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CategoricalFormat", "EvalSampling", "FlowSpec", "ModelInput", "StudyParams"]
