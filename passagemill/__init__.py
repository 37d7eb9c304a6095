"""passagemill: retrieval-augmented-generation data work as Spark jobs.

Raw text goes in, sentence-grouped chunks with checked vectors come out, and
whole tables of questions are answered by cosine top-k over those chunks.
"""

import sys

from pyspark import cloudpickle

# Tasks carry the package's own functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
