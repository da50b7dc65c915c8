"""Training-data pipeline operators; nothing outside this subpackage imports it.

Their functions travel to executors by value, so that workers need no copy of the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
