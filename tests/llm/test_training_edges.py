"""The training-data operators on hostile, empty and clashing input, and that each result comes through its method."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import compression_quality, fm_dedup, html_extraction, language_id, media, quality_rules, sentence_pieces
from lodestrata.llm.common import word_hashes

# ---- words


def test_long_words_are_told_apart():
    a, b = b"a" * 4096, b"b" * 4096
    swapped = str.maketrans("ab", "ba")
    thue = "".join("ab"[i.bit_count() % 2] for i in range(1 << 12))
    texts = [a + b, b + a, thue.encode(), thue.translate(swapped).encode(), b"x" * 48, b"x" * 49, b"ab", b"ba"]
    hashes, starts = word_hashes(texts)
    assert starts.tolist() == list(range(9)) and len(set(hashes.tolist())) == 8
    assert word_hashes([b" ".join(texts)])[0].tolist() == hashes.tolist()


# ---- 1 sentence pieces


def test_ranks_become_log_probabilities():
    v = sentence_pieces.vocabulary(sentence_pieces.read_model())
    proper = np.array([i for i, x in v.pieces.values() if x > -1e8])
    assert abs(np.exp(v.scores[proper]).sum() - 1) < 1e-2 and (v.scores[proper] < 0).all()
    ids = sentence_pieces.encode_texts(v, ["The council met"], 1)[0].to_pylist()[0]
    assert [v.bytes[i] for i in ids] == [b" The", b" council", b" met"]


# ---- 2 HTML

PROSE = "This is a paragraph of running text, which goes on for a while, so that it counts as one."


@pytest.mark.parametrize(
    ("body", "want"),
    [
        # no article or main element: the container is found by its points
        (f"<div id=top><ul><li><a href=/>Home</a><li><a href=/b>More, and more</a></ul></div><div id=x><h2>T</h2><p>{PROSE}</p><p>{PROSE}</p></div><div><a href=/c>{PROSE}</a></div>", f"T\n{PROSE}\n{PROSE}"),
        (f"<div><div class=col><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div><div class=col2><p><a href=/>{PROSE}</a></p></div></div>", "\n".join([PROSE] * 3)),
        # unwanted names go, whatever else the name says
        *[(f"<article><h1>T</h1><p>{PROSE}</p><div class={c}><p>{PROSE} No.</p></div></article>", f"T\n{PROSE}")
            for c in ("sidebar-content", "comment-body", "footer-content", "ad-text", "cookie-text",
            "related-content")],
        *[(f"<div class=wrap><p>{PROSE}</p><p>{PROSE}</p></div><div class={c}><p>{PROSE} No.</p></div>",
            f"{PROSE}\n{PROSE}") for c in ("sidebar-content", "comment-body")],
        # unless the article stands in them
        (f"<div class='content with-sidebar'><article><p>{PROSE}</p></article></div>", PROSE),
        (f"<div class=sidebar-layout><main><p>{PROSE}</p></main></div>", PROSE),
        # a headline stays in its article, however it is marked
        (f"<main><div class=header><h1>Head</h1></div><p>{PROSE}</p></main>", f"Head\n{PROSE}"),
        (f"<article><header><h1>Head</h1></header><p>{PROSE}</p></article>", f"Head\n{PROSE}"),
        # short paragraphs and deep ones count
        (f"<div><div><div><div><div><div><div><p>Yes.</p><p>{PROSE}</p></div></div></div></div></div></div></div>",
            f"Yes.\n{PROSE}"),
    ],
)
def test_html_planted_pages(body, want):
    page = f"<html><body><nav><a href=/>Menu</a></nav>{body}<footer>Foot, and so on</footer></body></html>"
    assert html_extraction.main_text(page) == want


@pytest.mark.parametrize("part", ["<a ", "<div>", "<li>", "<ul><li>", '<p class="x', "<a href='x>", "<article>", "<!--",
    "<table><tr><td>", "<div class=sidebar>", "</div>", "<b>"])
def test_html_takes_time_in_proportion(part):
    began = time.perf_counter()
    assert isinstance(html_extraction.main_text(part * 20_000 + "x"), str)
    assert time.perf_counter() - began < 10


def test_html_odd_tables(spark):
    rows = [(1, "u", f"<p>{PROSE}</p>", "clash", 5)] * 2 + [(None, None, None, None, None), (2, "u", "", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = Counter(map(tuple, html_extraction.extract(pages).collect()))
    assert got == Counter([(1, "u", PROSE, len(PROSE))] * 2 + [(None, None, "", 0), (2, "u", "", 0)])
    assert html_extraction.extract(pages.limit(0)).count() == 0


# ---- 3 language


@pytest.mark.parametrize("lane", [1, 2, 7, 512])
def test_phrases_cross_lanes(lane):
    rng = random.Random(lane)
    train = [rng.randint(1, 3) for _ in range(300)]
    table, said = language_id.parse_table(train, 6), "".join(map(str, train))

    def plain(codes):
        n = i = 0
        while i < len(codes):
            j = i + 1
            while j < len(codes) and "".join(map(str, codes[i : j + 1])) in said:
                j += 1
            n, i = n + 1, j
        return n

    texts = [[rng.randint(1, 4) for _ in range(rng.choice([0, 1, 9, 90]))] for _ in range(30)] + [train[5:250],
        train * 3]
    codes, starts = np.array(sum(texts, []), np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert language_id.phrases(codes, starts, table, 6, lane).tolist() == [plain(t) for t in texts]


# ---- 4 substring dedup


def shard_of(texts, n, window):
    """Segments as a shard gets them: one a text, n of each."""
    words = [word_hashes([t.encode()])[0].tobytes() for t in texts]
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, ids, pa.array([n] * len(texts), pa.int64()), pa.array(words,
        pa.binary())], names=["v", "s1", "s2", "n", "words"])


def test_only_backward_search_finds_repeats(monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    parts = [shard_of([f"a b {passage} c", f"d {passage} e f"], 1, 35)]
    found = fm_dedup.search_shard(parts, 35).to_pydict()
    assert found["v"] == [0, 1] and found["spans"] == [[2, 8], [1, 7]]
    again = fm_dedup.search_shard([shard_of([passage], 2, 35)], 35).to_pydict()
    assert again["spans"] == [[0, 6]]
    assert fm_dedup.search_shard([shard_of([passage], 1, 35)], 35).num_rows == 0
    monkeypatch.setattr(fm_dedup, "repeated_windows", lambda index, text, begins, ends, window: np.zeros(len(text),
        bool))
    assert fm_dedup.search_shard(parts, 35).num_rows == 0
    assert fm_dedup.search_shard([shard_of([passage], 2, 35)], 35).num_rows == 0


# ---- 8 compression


def test_scores_are_of_compressed_sizes_alone():
    good, bad = b"the quick brown fox jumps over the lazy dog " * 30, b"zzqq xkcd 9981 qwrt 7712 " * 30
    near_good = compression_quality.measures(b"the quick brown fox jumps over it", good, bad)
    near_bad = compression_quality.measures(b"qwrt 7712 zzqq xkcd 9981 zzqq", good, bad)
    assert near_good[0] > 0 > near_bad[0] and near_good[2] == near_bad[2] == 1.0
    assert compression_quality.measures(b"", good, bad) == (0.0, 1.0, 1.0)


# ---- 10 media


def test_any_bytes_can_be_read():
    rng = random.Random(3)
    for _ in range(400):
        stream = bytearray(media.write(media.padded(bytes(rng.randrange(256) for _ in range(rng.randint(0, 2000))))))
        for _ in range(rng.randint(1, 30)):
            stream[rng.randrange(len(stream))] = rng.randrange(256)
        got = media.read(bytes(stream[: rng.randint(0, len(stream))]))
        assert set(got) == {"packets", "programs", "units", "faults"}


def test_tables_over_several_packets():
    streams = b"".join(b"\x06" + (0xE000 | 0x100 + i).to_bytes(2, "big") + b"\xf0\x00" for i in range(60))
    section = media._section(2, 1, (0xE000 | 0x100).to_bytes(2, "big") + b"\xf0\x00" + streams)
    first = b"\x47" + (0x4000 | media.PMT_PID).to_bytes(2, "big") + b"\x10\x00" + section[:183]
    rest = (b"\x47" + media.PMT_PID.to_bytes(2, "big") + b"\x11" + section[183:]).ljust(188, b"\xff")
    assert len(media.read(media.TABLES[:188] + first + rest)["programs"][1]) == 60
    assert media.read(media.TABLES[:188] + first + first + rest)["programs"] in ({}, {1: {0x100 + i: 6
        for i in range(60)}})


def test_units_are_stored(spark):
    docs = spark.createDataFrame([(1, "x" * 100_000)], "doc_id long, text string")
    units = media.media_columns(docs).first()["units"]
    assert [u["pts"] for u in units] == [media.TICKS * i for i in range(len(units))] and sum(u["bytes"]
        for u in units) == 100_032
    assert [u["random_access"] for u in units] == [i % media.RAP_EVERY == 0 for i in range(len(units))]


# ---- empty tables, and the pipeline


def test_empty_tables(odd):
    none = odd.limit(0)
    assert sentence_pieces.encode(none).count() == quality_rules.score(none).count() == media.media_columns(
        none).count() == quality_rules.keep(none).count() == 0


def test_pipeline_on_odd_and_clashing_input(spark, odd):
    import corpus_pipeline as P

    names = ("n_removed", "kept", "copies", "turn", "row", "th", "of", "of_th", "mix_row", "mix_level_0", "tokens",
        "n_chars")
    docs = odd.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
        for c in names if c != "n_chars"})
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    own = {r["doc_id"]: tuple(r[c] for c in names[:-1]) for r in docs.collect()}
    left = docs
    for i, (name, stage) in enumerate(P.STAGES[:4]):
        if i:  # the rules keep none of these texts
            after = stage(spark, left, "")
            path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{i}"
            after.write.mode("overwrite").parquet(path)
            left = spark.read.parquet(path)
        else:
            assert stage(spark, left, "").columns == docs.columns
        assert left.columns == docs.columns, name
        assert all(tuple(r[c] for c in names[:-1]) == own[r["doc_id"]] for r in left.collect()), name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert texts[6].startswith("The quick brown fox") and len(texts) > 5
    assert left.where("text is not null and n_chars <> length(text)").count() == 0


# ---- 2 HTML: names against text


@pytest.mark.parametrize("names", ["class='content sidebar-right'", "class='post-body share-enabled'", "class='entry-content tags-on'", "class='story legal'",
    "class='text-toc'", "class='post notice'", "id=main class=sidebar-left", "class=header-content", "class=legal-opinion", "class=search-results-article",
    "class='post side-by-side'", "class='page has-sidebar'", "class='content with-toc'", "class=story-tags"])
def test_html_names_do_not_lose_the_article(names):
    body = f"<div {names}><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div>"
    want = f"T\n{PROSE}\n{PROSE}"
    assert html_extraction.main_text(f"<body><nav><a href=/>Menu</a></nav>{body}<footer>Foot</footer></body>") == want
    assert html_extraction.main_text(f"<body>{body}<div class=sidebar-content><p>{PROSE} No.</p></div><div class=comment-body><p>{PROSE} No.</p></div></body>") == want


def test_html_comments_go_even_where_they_are_most_of_a_page():
    comments = "<div id=comments><ol class=comment-list>" + "".join(f"<li class=comment><article class=comment-body><p>{PROSE} {i}</p></article>" for i in range(9))
    comments += "</ol></div>"
    for frame in ("<div class=post>{}</div>", "<article>{}</article>", "<form id=f><div class=post>{}</div><input></form>"):
        page = "<body>" + frame.format(f"<h1>T</h1><p>{PROSE}</p>") + comments + "</body>"
        assert html_extraction.main_text(page) == f"T\n{PROSE}"
    assert html_extraction.main_text(f"<body>{comments}</body>").count(PROSE) == 9


@pytest.mark.parametrize("seed", range(40))
def test_html_points_equal_the_plain_definition(seed):
    """Points by recursion over all pairs of paragraph and ancestor, against the one pass from the leaves."""
    rng = random.Random(seed)

    def page(depth):
        if depth == 0 or rng.random() < 0.25:
            text = ", ".join("word" * rng.randint(1, 9) for _ in range(rng.randint(1, 6)))
            return f"<p>{text}<a href=/>{'link' * rng.randint(0, 5)}</a></p>"
        return f"<div class={rng.choice(['a', 'content', 'legal'])}>" + "".join(page(depth - 1) for _ in range(rng.randint(1, 3))) + "</div>"

    root = html_extraction.parse("<body>" + page(4) + page(4) + "</body>")
    html_extraction.settle(root)
    found = {id(e): e.points for e in html_extraction.measure(root)}

    def text(e):
        return "".join(c if isinstance(c, str) else text(c) for c in e.children)

    def links(e):
        return sum(len(text(c)) if c.tag == "a" else links(c) for c in e.children if not isinstance(c, str))

    want = Counter()

    def visit(e, above):
        if e.tag == "p" and text(e):
            own = (text(e).count(",") + len(text(e)) / 100) * (1 - links(e) / len(text(e)))
            for a in reversed(above):
                own *= 0.1 if a.named else 1
                want[id(a)] += own
                own /= 2
        for c in e.children:
            if not isinstance(c, str):
                visit(c, [*above, e])

    visit(root, [])
    assert found.keys() == {k for k, v in want.items() if v > 0}
    assert all(abs(found[k] - want[k]) < 1e-9 for k in found)
