"""Lines of pages as a stream: each page is aligned once all of its lines have come, or time for them is over.

The lines of open pages are kept in keyed state, which the checkpoint folder restores after a loss; a page leaves it when
its time is over.  Aligned pages go to a file sink, whose log makes each batch count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import align
from ..operators.page_table import PARTNERS, partners

#: A line of a page: side is pred or truth; n_pred and n_truth are the numbers of lines that the page has.
LINE = "page_id long, side string, idx int, text string, n_pred int, n_truth int, ts timestamp"


#: A page that is done, with its lines in order.
PAGE = "page_id long, p array<string>, g array<string>, complete boolean"


def _page(page: int, sides: dict[str, dict[str, str]], complete: bool) -> pd.DataFrame:
    order = lambda s: [s[i] for i in sorted(s, key=int)]
    return pd.DataFrame({"page_id": [page], "p": [order(sides["pred"])], "g": [order(sides["truth"])], "complete": [complete]})


def align_stream(lines: DataFrame, late: str = "30 minutes", wait: str = "10 minutes") -> DataFrame:
    """The rows of `align.align_pages`, and whether the page was complete, of pages as they become so.

    lines: LINE.  A line counts once, by its place; the first text of a place stays.  A page that is not complete when the
    watermark, `late` behind the latest time seen, has passed its latest line by `wait` is aligned as it is.  Lines of a page
    that is done change nothing; those behind the watermark are dropped.  A null text is an empty one.
    """
    gap = int(pd.Timedelta(wait).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            sides, done = json.loads(state.get[0]), state.get[1]
            state.remove()
            if not done:
                yield _page(key[0], sides, False)
            return
        sides, done, latest = ({"pred": {}, "truth": {}}, False, 0) if not state.exists else (json.loads(state.get[0]), state.get[1], state.get[2])
        need = None
        for rows in batches:
            latest = max(latest, int(rows.ts.max().timestamp() * 1000))
            need = int(rows.n_pred.iloc[-1]), int(rows.n_truth.iloc[-1])
            if not done:
                for side, i, x in zip(rows.side, rows.idx, rows.text, strict=True):
                    sides[side].setdefault(str(i), "" if x is None else x)
        if not done and need and (len(sides["pred"]), len(sides["truth"])) == need:
            yield _page(key[0], sides, True)
            sides, done = {"pred": {}, "truth": {}}, True
        state.update((json.dumps(sides), done, latest))
        state.setTimeoutTimestamp(max(latest + gap, state.getCurrentWatermarkMs() + 1))

    known = lines.select("page_id", "side", "idx", "text", "n_pred", "n_truth", "ts").withWatermark("ts", late)
    done = known.groupBy("page_id").applyInPandasWithState(step, PAGE, "lines string, done boolean, latest long", "append", GroupStateTimeout.EventTimeTimeout)
    rows = done.mapInArrow(partners, PARTNERS + ", complete boolean")  # pages of a batch are aligned together
    return align.pair_rows(rows, "complete")


def start(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what is there to Parquet in `out`; after a loss the same call goes on from the checkpoint folder."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_lines(preds: DataFrame, truth: DataFrame, sizes: DataFrame) -> DataFrame:
    """LINE rows of predictions (page_id, pred_idx, pred, ts) and truth (page_id, gt_idx, gt, ts); sizes: page_id, n_pred, n_truth."""
    sides = [d.select("page_id", F.lit(side).alias("side"), F.col(i).cast("int").alias("idx"), F.col(x).alias("text"), "ts") for d, side, i, x in ((preds, "pred", "pred_idx", "pred"), (truth, "truth", "gt_idx", "gt"))]
    return sides[0].unionByName(sides[1]).join(sizes, "page_id").select("page_id", "side", "idx", "text", "n_pred", "n_truth", "ts")
