"""Small tables with every awkward row: nulls, empty and long texts, ties,
repeated rows, an extra column with a clashing name."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id long"


def frame(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 7, 9) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def near_copies():
    """Random texts over few words with exact and near copies and nulls."""
    rng, rows = random.Random(5), []
    for i in range(250):
        k = rng.random()
        if k < 0.3 or not rows:
            x = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))
        elif k < 0.9:
            w = (rng.choice(rows[-60:])[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice("abcdefgh")
            x = " ".join(w).upper() if rng.random() < 0.3 else "\t".join(w)
        else:
            x = None
        rows.append((i, x))
    return rows
