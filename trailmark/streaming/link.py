"""Linking of a stream of frames: the batch step with its state kept per arena of a video.

Rows of a micro-batch are sorted by frame; frames not after the last one seen are dropped, and
frames skipped in between count as frames without candidates, with a row each. With `longest_gap`, more skipped
frames than that begin the arena anew instead, without rows for them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions.common import keyed
from ..operators.linking import LINKED, Linker, Settings, linked

#: One JSON text: the state has parts that may be missing.
STATE = "state string"


def link_stream(frames: DataFrame, settings: Settings, longest_gap: int | None = None) -> DataFrame:
    """frames: a streaming DataFrame ((video,) roi, frame, cs)."""
    place = keyed(frames, "roi")
    schema = ", ".join(f"{c} string" for c in place) + ", " + LINKED
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, batches, state):
        import pandas as pd

        fresh = lambda: Linker(settings, settings.centers.get(key[-1], (0.0, 0.0)))
        linker, seen = fresh(), -1
        if state.exists:
            *held, seen = json.loads(state.get[0])
            linker.restore(*held)
        out = []
        rows = pd.concat(list(batches)).sort_values("frame")
        for frame, cs in rows[["frame", "cs"]].itertuples(index=False):
            if frame <= seen:
                continue
            if longest_gap is not None and frame - seen - 1 > longest_gap:
                linker, seen = fresh(), int(frame) - 1
            for f in range(seen + 1, frame + 1):
                own = cs if f == frame else []
                out.append((*key, *linked(f, own, linker.step([(c["x"], c["y"], c["area"]) for c in own]))))
            seen = int(frame)
        state.update((json.dumps([*linker.state(), seen]),))
        yield pd.DataFrame(out, columns=names)

    return frames.groupBy(*place).applyInPandasWithState(run, schema, STATE, "append", "NoTimeout")
