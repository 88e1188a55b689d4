"""textmine — labelled-text analytics on PySpark.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, joins, aggregates and windows.  Sub-packages:

* ``sources``    – corpus, word-list, dictionary and annotation readers
* ``functions``  – column-level helpers (regex specs, globs, fixed lexicons)
* ``operators``  – tokens, markers, document-feature tables, proximity,
                   folds, Naive Bayes, SVM, metrics
* ``plans``      – feature-set compositions and the registered queries
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task itself, so executors
# need neither this package installed nor the driver's ``sys.path``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from textmine.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
