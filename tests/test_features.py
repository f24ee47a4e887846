import numpy as np
import pandas as pd

import brute
from recording import START
from tickloom.plans.features import feature_table
from tickloom.schemas import FEATURE_COLUMNS


def test_feature_rows_match_row_loop(windows, recordings):
    got = feature_table(windows).toPandas().sort_values(["ticker", "ts_ms"]).reset_index(drop=True)
    assert list(got.columns) == FEATURE_COLUMNS
    rows = recordings[1]
    last = [r for r in rows["M2"] if r["event_type"] == "cfbenchmarks_value"][-1]
    import json

    yes2 = float(float(json.loads(last["payload"]["msg"]["data"])["value"]) >= 100.0)
    want = brute.features(rows["M1"], "M1", START + 900, 100.0, 1.0, "fragmented")
    want += brute.features(rows["M2"], "M2", START + 900, 100.0, yes2)
    want = pd.DataFrame(want)
    assert len(got) == len(want) > 200
    for name in FEATURE_COLUMNS[1:]:
        a, b = got[name], want[name]
        if a.dtype == object:
            assert a.tolist() == b.tolist(), name
        else:
            np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=name)
