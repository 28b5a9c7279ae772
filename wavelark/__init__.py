"""Environmental-sound analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship task code with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
