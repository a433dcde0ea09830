"""Table functions for SQL, the same as the column forms: markers of a prompt, cells of a grid.

    SELECT d.id, p.* FROM docs d, LATERAL prompt_parts(d.prompt, d.images) p
    SELECT d.id, c.* FROM docs d, LATERAL grid_cells(d.result) c

``registered`` makes them known to a session. Nulls and edges: a NULL text gives no rows, as does a grid that is no
object; a cell that is missing or not numeric weighs 1, as in ``jsonclean.patch_grid``; other keys are no cells.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from placegrid.functions.numbers import NUMBER

MARKER, RANGE = re.compile(r"\{IMAGE_([0-9]+)\}"), re.compile(r"\{IMAGE_([0-9]+)-([0-9]+)\}")
NUMERIC = re.compile(NUMBER)


@udtf(returnType="pos: int, kind: string, value: string")
class PromptParts:
    """The texts and images of a prompt in order, with ranges of images written out."""

    def eval(self, text: str | None, images: int | None) -> Iterator[tuple[int, str, str]]:
        if text is None:
            return
        whole = RANGE.sub(lambda m: " ".join(f"{{IMAGE_{i}}}" for i in range(int(m[1]), int(m[2]) + 1)), text)
        pos = 0
        for i, part in enumerate(MARKER.split(whole)):
            if i % 2 and images is not None and int(part) < images:
                yield pos, "image", part
            elif i % 2 or not part.strip(" "):
                continue
            else:
                yield pos, "text", part.strip(" ")
            pos += 1


def _weight(value: object) -> float:
    text = value if isinstance(value, str) else json.dumps(value)
    text = {"true": "1", "false": "0"}.get(text, text.strip(" "))
    return min(max(float(text), 0.0), 2.0) if NUMERIC.match(text) else 1.0


@udtf(returnType="row: int, col: int, w: double")
class GridCells:
    """The cells of a grid of ``side`` x ``side``: rows and columns from 0, weights limited to [0, 2]."""

    def eval(self, text: str | None, side: int = 4) -> Iterator[tuple[int, int, float]]:
        try:
            cells = json.loads(text) if text is not None else None
        except ValueError:
            cells = None
        if isinstance(cells, dict):
            for r in range(side):
                for c in range(side):
                    yield r, c, _weight(cells.get(f"{chr(65 + r)}{c + 1}", ""))


def registered(spark: SparkSession) -> SparkSession:
    spark.udtf.register("prompt_parts", PromptParts)
    spark.udtf.register("grid_cells", GridCells)
    return spark
