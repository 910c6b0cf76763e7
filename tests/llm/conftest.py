import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in any column, empty and odd texts, repeated rows, ties, and columns named like results."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    passage = " ".join(f"common{i}" for i in range(60))
    texts = ["", None, " \t\n ", "one", "one", "two words", "The quick brown fox, it jumps over the lazy dog and runs.",
        passage, passage + " and more", "x " * 80, "x " * 80, long, "😀 ▁   ß z", "NUL\x00 inside", "y" * 5000, passage]
    rows = [(i if i != 5 else None, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", 1, 2,
        "clash", "clash") for i, t in enumerate(texts)]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, shard int, "
        "token_ids string, spans string")
