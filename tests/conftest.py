import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tickloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, "tickloom-tests")


@pytest.fixture(scope="session")
def recordings(tmp_path_factory):
    """Two windows in three files: M1 in two overlapping fragments, M2 in one gzip file."""
    from recording import write_recording

    root = tmp_path_factory.mktemp("recordings")
    rows = {}
    first = write_recording(None, "M1", n=2600, seed=1)
    cut = 1400
    from recording import dump

    dump(first[:cut], root / "events_b.jsonl")
    dump([first[0], *first[cut:]], root / "events_a.jsonl.gz")
    rows["M1"] = first[:cut] + [first[0], *first[cut:]]
    rows["M2"] = write_recording(root / "events_c.jsonl.gz", "M2", n=1500, seed=2, result="")
    return root, rows


@pytest.fixture(scope="session")
def windows(spark, recordings):
    from tickloom.plans.state import Windows
    from tickloom.sources.recordings import scan_recordings

    return Windows.from_recordings(scan_recordings(spark, str(recordings[0])), slice_ms=5_000)
