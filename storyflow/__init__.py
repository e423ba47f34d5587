"""storyflow: find and digest news stories that several publishers cover, on Spark.

Every public function takes and returns DataFrames (or Columns), so Catalyst
plans the whole job; see README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

# Workers need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
