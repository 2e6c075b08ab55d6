"""Evidence-anchored graph analytics over long-form text, on Spark.

functions   column expressions
operators   DataFrame to DataFrame
sources     tables, uploads, ontology, stores
plans       ingestion chain, question answering, registered queries
streaming   telemetry and conversation streams
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
