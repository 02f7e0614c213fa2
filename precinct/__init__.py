"""precinct: incident analytics as Spark DataFrame operators."""

import os

# The driver's matrices are small: one thread is enough, and nothing depends on a thread pool beside the JVM's.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
