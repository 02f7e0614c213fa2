import os
import signal
import sys

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import pytest  # noqa: E402

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


#: Seconds that one test may take.
LIMIT = 300


@pytest.fixture(autouse=True)
def limited():
    def stop(*_):
        raise TimeoutError(f"more than {LIMIT} seconds")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(LIMIT)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark():
    from precinct.session import local_session

    s = local_session("4", "tests", "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
