"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import compression_quality, fm_dedup, html_extraction, jaccard_join, language_id, media, mixing, quality_rules, sentence_pieces, sharding
from lodestrata.llm.common import numbered_words, table, word_hashes


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words_of(text):
    return (text or "").encode().split()


# ---- words


def test_words_and_hashes_agree():
    texts = [b"", b"a b\tc", b"  ", "ü x \x1c y".encode(), b"z" * 9000 + b" " + b"z" * 9001]
    ids, starts, _ = numbered_words(texts)
    hashes, begins = word_hashes(texts)
    assert starts.tolist() == begins.tolist() == [0, 0, 3, 3, 6, 8]
    assert len(set(hashes.tolist())) == len(set(ids.tolist()))


# ---- 1 sentence pieces


@pytest.fixture(scope="module")
def vocabulary():
    return sentence_pieces.vocabulary(sentence_pieces.read_model())


def every_segmentation(v, s):
    edges = v.edges(s)

    def go(end):
        if end == 0:
            yield 0.0, []
        for start, piece, x in edges[end] if end else ():
            for score, ids in go(start):
                yield score + x, ids + ([piece] if piece >= 0 else v.spelt(s[start]))

    return sorted(go(len(s)), key=lambda x: -x[0])


@pytest.mark.parametrize("text", [" the", " hello", "thand oß", " 😀 a", "\n a b", " aaaa", "  x"])
def test_nbest_is_exact(vocabulary, text):
    want = every_segmentation(vocabulary, text)[:5]
    got = vocabulary.nbest(text, 5)
    assert [x for x, _ in got] == [x for x, _ in want]
    assert all(b"".join(map(vocabulary.bytes.__getitem__, ids)).decode() == text for _, ids in got)


def test_batched_segments_equal_the_search_over_the_whole_text(vocabulary):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "andüber", "x", "qqqq", "", "e%%%", "tion\nen"]) for _ in range(rng.randint(0,
        14))) for _ in range(30)]
    lists, scores, more = sentence_pieces.encode_texts(vocabulary, texts, 3)
    for t, ids, score, others in zip(texts, lists.to_pylist(), scores, more, strict=True):
        whole = vocabulary.nbest(" " + t, 3)
        assert [x for x, _ in whole] == [score, *(o["score"] for o in others)]
        assert vocabulary.decode(ids) == t
        for o in others:
            edited = list(ids)
            for e in reversed(o["edits"]):
                edited[e["at"] : e["at"] + e["drop"]] = e["ids"]
            assert vocabulary.decode(edited) == t


def test_encoding_odd_documents(odd):
    got = sentence_pieces.encode(odd).collect()
    assert len(got) == odd.count() and all(r["decoded"] for r in got)
    back = sentence_pieces.decode(sentence_pieces.encode(odd)).groupBy("doc_id").agg(F.first("text").alias("text"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in odd.collect()}
    kept = sentence_pieces.encode(odd, keep=True)
    assert set(odd.columns) - {"token_ids"} <= set(kept.columns) and kept.count() == odd.count()


# ---- 2 HTML


def test_html_keeps_the_article_only():
    page = """<html><head><title>T &amp; x</title><style>p{}</style></head><body><header>Site, name</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies, a lot of them, all over the site</div><article><h1>Head</h1><p>First   paragraph,
    with a good&nbsp;deal of text, &lt;and&gt; commas.<p>Second <b>one</b>, without an end tag, but long enough.<script>var p = "<p>no</p>";</script><ul><li>item</ul></article>
    <aside>Related, things, to read, and more</aside><div id=comments><p>Nice post, really, thanks a lot for it</p></div><form><label>Name</label></form><footer>&copy; me</footer></body>"""
    assert html_extraction.main_text(
        page) == "Head\nFirst paragraph, with a good deal of text, <and> commas.\nSecond one, without an end tag, but long enough.\nitem"


@pytest.mark.parametrize("page", ["", None, "plain", "<", "<p>", "</p></div>", "<!-- open", "<script>never closed",
    "<div>" * 3000 + "deep" + "</div>" * 3000, "<a href='x>y", "\x00<p>z</p>"])
def test_html_survives_anything(page):
    assert isinstance(html_extraction.main_text(page), str)


def test_pages(spark, small):
    pages = table(spark, small, "pages")
    got = html_extraction.extract(pages.unionByName(pages.limit(1).select(F.lit(None).cast("long").alias("page_id"),
        "url", F.lit(None).cast("string").alias("html")))).collect()
    assert len(got) == pages.count() + 1
    assert all(r["n_chars"] == len(r["text"]) and "track(" not in r["text"] and "&copy;" not in r["text"] for r in got)


# ---- 3 language


def test_cross_parsing_counts_phrases():
    train, width = [1, 2, 1, 3, 2, 1], 6
    t = language_id.parse_table(train, width)
    have = {tuple(train[i:j]) for i in range(len(train)) for j in range(i + 1, len(train) + 1)}

    def plain(codes):
        n = i = 0
        while i < len(codes):
            j = i + 1
            while j < len(codes) and tuple(codes[i : j + 1]) in have:
                j += 1
            n, i = n + 1, j
        return n

    rng = random.Random(1)
    texts = [[rng.randint(1, 4) for _ in range(rng.randint(0, 30))] for _ in range(50)]
    codes, starts = np.array(list(itertools.chain(*texts)), np.int64), np.concatenate([[0], np.cumsum([len(x)
        for x in texts])])
    assert language_id.phrases(codes, starts, t, width).tolist() == [plain(x) for x in texts]


def test_language_held_out_accuracy(spark, small):
    docs = table(spark, small, "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["held_out"] for r in got} == {True, False} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"])
        .encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_language_of_odd_documents(odd, spark):
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert all(got[i]["lang_pred"] == "und" for i in (0, 1, 2)) and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where(
        "lang_pred <> 'und'").count() == 0
    assert language_id.identify(odd.limit(0)).count() == 0


# ---- 4 substring dedup


def plain_strip(texts, window):
    where = Counter(tuple(w[i : i + window]) for w in map(words_of, texts) for i in range(len(w) - window + 1))
    out = []
    for w in map(words_of, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if where[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_wavelet_tree_and_backward_search():
    rng = random.Random(2)
    for _ in range(20):
        segments = [[rng.randint(1, rng.choice([2, 5, 40])) for _ in range(rng.randint(1, 50))]
            for _ in range(rng.randint(1, 8))]
        segments.append(segments[0][len(segments[0]) // 4 :])
        ends = np.cumsum([len(s) + 1 for s in segments])
        text, inside = np.zeros(ends[-1], np.int64), np.ones(ends[-1], bool)
        inside[ends - 1] = False
        text[inside] = np.concatenate(segments)
        index = fm_dedup.FMIndex(text, ends - 1, 42)
        transform = text[fm_dedup.suffix_array(text, ends - 1) - 1]
        for c, p in [(rng.randint(1, 41), rng.randint(0, len(text))) for _ in range(30)]:
            if index.tree.freq[c]:
                assert int(index.tree.rank(np.array([c]), np.array([p]))[0]) == int((transform[:p] == c).sum())
        window = rng.choice([3, 6, 11])
        found = fm_dedup.repeated_windows(index, text, ends - 1 - [len(s) for s in segments], ends - 1, window)
        count = Counter(tuple(s[i : i + window]) for s in segments for i in range(len(s) - window + 1))
        for s, e in zip(segments, ends, strict=True):
            b = e - 1 - len(s)
            assert [bool(found[b + i]) for i in range(len(s) - window + 1)] == [count[tuple(s[i : i + window])] > 1
                for i in range(len(s) - window + 1)]


@pytest.mark.parametrize(("window", "options"), [(35, {}), (8, {"hot": 1}), (8, {"hot": 2, "shard_words": 50,
    "filter_bits": 8})])
def test_strip_equals_brute_force(spark, window, options):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    texts = []
    for _ in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            cut = rng.randint(0, 40)
            piece = passage[cut : cut + rng.randint(5, 50)]
            if rng.random() < 0.3:
                piece[rng.randrange(len(piece))] = "edit"
            body = body[:20] + piece + body[20:]
        texts.append(" ".join(body))
    texts += [texts[3], "again " * 100, None, ""]
    got = fm_dedup.strip(docs_of(spark, texts), window, **options).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept"]) for r in got] == plain_strip(texts, window)


def test_strip_odd_documents(odd):
    rows = odd.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, plain_strip([r["text"] for r in rows], 35), strict=True))
    assert Counter(tuple(r) for r in fm_dedup.strip(odd).select("doc_id", "n_words", "n_removed", "kept")
        .collect()) == want
    kept = fm_dedup.strip(odd, keep=True)
    assert kept.count() == len(rows) and "lang" in kept.columns
    assert fm_dedup.strip(odd.limit(0)).count() == 0


# ---- 5 mixing


def test_shortages_go_to_siblings_first():
    supply = {("a", "x"): 100, ("a", "y"): 1000, ("b", "z"): 1000}
    got = mixing.budgets(supply, lambda path: 1.0, 1000, 1)
    assert got == {("a", "x"): 100, ("a", "y"): 400, ("b", "z"): 500}
    got = mixing.budgets(supply, lambda path: 1.0, 2000, 1)
    assert got == {("a", "x"): 100, ("a", "y"): 900, ("b", "z"): 1000}
    assert mixing.budgets(supply, lambda path: 1.0, 99_999, 2) == {k: 2 * v for k, v in supply.items()}
    assert sum(mixing.budgets(supply, lambda path: len(path[-1]) + 0.37, 777, 1).values()) == 777


def test_mix_takes_prefixes_within_budget(spark, small):
    docs = table(spark, small, "documents")
    levels = [mixing.domain_of(), F.col("lang"), F.col("source")]
    plan = {tuple(r[f"mix_level_{i}"] for i in range(3)): r for r in mixing.decide(docs, levels, mixing.smoothed(0.5),
        0.5, 3).collect()}
    taken: dict = {}
    for r in mixing.select(docs, levels, mixing.smoothed(0.5), 0.5, 3).withColumn("tokens",
        mixing.tokens_of()).collect():
        key = tuple(r[f"mix_level_{i}"] for i in range(3))
        taken[key] = taken.get(key, 0) + r["tokens"] * r["copies"]
    total = docs.select(F.sum(mixing.tokens_of())).first()[0]
    assert sum(r["budget"] for r in plan.values()) == round(total * 0.5)
    ranked = docs.withColumns({f"mix_level_{i}": F.coalesce(c, F.lit("none")) for i,
        c in enumerate(levels)}).withColumn("tokens", mixing.tokens_of())
    for key, leaf in plan.items():
        passes, rest = divmod(leaf["budget"], leaf["tokens"])
        own = ranked.where((F.col("mix_level_0") == key[0]) & (F.col("lang") == key[1]) & (F.col(
            "source") == key[2])).select("tokens", mixing._rank(F.lit(passes).cast("long"), mixing.SEED).alias(
            "h")).orderBy("h").collect() if key in list(plan)[:6] else None
        if own is not None:
            run = list(itertools.takewhile(lambda x: x <= rest, itertools.accumulate(r["tokens"] for r in own)))
            assert taken.get(key, 0) == passes * leaf["tokens"] + (run[-1] if run else 0)
        assert taken.get(key, 0) <= leaf["budget"]


def test_mixing_odd_documents(odd):
    levels = [mixing.domain_of(), F.col("lang"), F.col("source")]
    assert mixing.select(odd, levels, mixing.smoothed(1.0), 1.0, 1).where(mixing.tokens_of() > 0).count() == odd.where(
        mixing.tokens_of() > 0).count()
    assert mixing.select(odd.limit(0), levels, mixing.smoothed(1.0), 1.0, 1).count() == 0


# ---- 6 sharding


@pytest.mark.parametrize("copies", [0, 30, 300])
def test_shards_are_even_and_keep_groups_together(spark, copies):
    texts = [f"text {i // 3 if i % 2 else i}" for i in range(301)] + ["hot"] * copies + [None]
    docs = docs_of(spark, texts)
    got = sharding.shards(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes.get(s, 0)))
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
    where: dict = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    split = [t for t, s in where.items() if len(s) > 1]
    # all groups stay whole while the quotas leave room; a group near or above a shard's quota costs some others theirs
    assert len(split) <= (0 if not copies else sum(len(s) > 0 for s in where.values()) // 4)


def test_sharding_odd_documents(odd):
    assert sharding.shards(odd).count() == odd.count() and sharding.shards(odd.limit(0)).count() == 0


# ---- 7 Jaccard join


def plain_groups(texts, k, percent):
    def shingles(t):
        w = [x.lower() for x in words_of(t)]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_groups_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    texts: list = []
    for _ in range(12):
        base = [f"v{rng.randint(0, 300)}" for _ in range(rng.choice([3, 30, 120, 300]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 50)}"
            texts.append(" ".join(copy[rng.choice([0, 0, 5]) :]))
    texts += ["", None, "  ", "Same here", "same HERE", "same here "]
    got = jaccard_join.grouped(docs_of(spark, texts), k, percent).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == plain_groups(texts, k, percent)


def test_least_overlap_is_exact():
    for na, nb in itertools.product(range(1, 60), repeat=2):
        x = jaccard_join.least_overlap(na, nb, 85)
        assert 100 * x >= 85 * (na + nb - x) and 100 * (x - 1) < 85 * (na + nb - x + 1)


def test_near_copies_of_odd_documents(odd):
    got = jaccard_join.grouped(odd, 4, 85).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and by[4]["component_id"] == 3 and by[15]["component_id"] == 7 and by[0][
        "component_id"] == 0
    assert by[1]["n_shingles"] == 0 and by[None]["component_id"] is None
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {0, 1, 2, 3, 6, 7}
    assert jaccard_join.grouped(odd.limit(0)).count() == 0


# ---- 8 compression


def test_compression_held_out_accuracy(spark, small):
    docs, labels = table(spark, small.replace("0.001", "0.01"), "documents"), table(spark, small.replace("0.001",
        "0.01"), "labels")
    got = compression_quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)


def test_compression_of_odd_documents(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = compression_quality.classify(odd, none).collect()
    assert len(got) == odd.count() and {r["score"] for r in got} == {0.5}
    assert compression_quality.classify(odd.limit(0), none).count() == 0


# ---- 9 quality rules


def plain_counts(text):
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or
        ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(odd, spark, small):
    for docs in (odd, table(spark, small, "documents").limit(60)):
        texts = [r["text"] for r in docs.collect()]
        got = Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
            for r in quality_rules.score(docs).collect())
        assert got == Counter(map(plain_counts, texts))


def test_rules_find_the_bad_documents(spark, small):
    more = small.replace("0.001", "0.01")  # what the votes tell of the rules needs some hundred documents
    docs, labels = table(spark, more, "documents"), table(spark, more, "labels")
    got = quality_rules.score(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) >= 0.95 * len(got)
    assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == {r["doc_id"] for r in quality_rules.score(docs)
        .where("kept").collect()}


def test_expectation_maximisation_finds_known_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((len(good), len(quality_rules.RULES)), int)
    rates = [0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.9, 0.6]
    for j, r in enumerate(rates):
        right = np.where(good, 1, -1)
        votes[:, j] = np.where(rng.random(len(good)) < 0.3, 0, np.where(rng.random(len(good)) < r, right, -right))
    code = ((votes + 1) * 3 ** np.arange(len(rates) - 1, -1, -1)).sum(1)
    model = quality_rules.fit(Counter(code.tolist()))
    found = [model["tables"][1, j, 2] / (model["tables"][1, j, 2] + model["tables"][1, j, 0])
        for j in range(len(rates))]
    assert abs(model["good"] - 0.8) < 0.03 and np.allclose(found, rates, atol=0.05)


# ---- 10 media


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 175, 176, 177, 184, 16383, 16384, 16385, 200_000])
def test_streams_give_payloads_back(size):
    text = bytes(random.Random(size).randrange(256) for _ in range(size))
    stream = media.write(media.padded(text))
    got = media.read(stream)
    assert len(stream) % 188 == 0 and b"".join(u[3] for u in got["units"]) == media.padded(text) and not any(got[
        "faults"].values())
    assert [u[1] for u in got["units"]] == [3600 * i for i in range(len(got["units"]))] and got["units"][0][2]
    assert got["programs"] == {1: {0x100: 6}}


def test_faults_are_found():
    stream = media.write(media.padded(b"abc" * 20_000))
    lost = stream[: 188 * 20] + stream[188 * 21 :]
    got = media.read(lost)
    assert got["faults"]["continuity"] == 1 and got["faults"]["broken_unit"] == 1
    assert media.read(stream[: 188 * 20] + stream[188 * 19 :])["faults"]["duplicate"] == 1
    assert media.read(b"\x00" * 188)["faults"]["sync"] == 1
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_media_of_odd_documents(odd):
    got = media.media_columns(odd, streams=True).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        payload = media.padded((texts[r["doc_id"]] or "").encode())
        assert r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r[
            "tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest() and "faults=0" in r["feature"]


# ---- pipeline


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as P

    text = lambda name: " ".join(f"{name}{i}" for i in range(70))
    near = text("c").rsplit(" ", 1)[0] + " other"
    rows = [(1, text("a"), "x"), (1, text("a"), "x"), (None, text("b"), "x"), (None, text("b"), "y"), (2, text("c"),
        "x"), (3, near, "x"), (3, text("d"), "x"), (4, text("e"), "x"), (None, text("e"), "x"), (None, "", "x"), (None,
        None, "x"), (5, text("f"), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    near_copies = P.near_copies_stage(spark, docs, "")
    want = Counter([(1, text("a"), "x"), (None, text("b"), "x"), (2, text("c"), "x"), (3, text("d"), "x"), (4, text(
        "e"), "x"), (None, "", "x"), (None, None, "x"), (5, text("f"), "x")])
    assert near_copies.columns == docs.columns and Counter(map(tuple, near_copies.collect())) == want
    assert Counter(tuple(r) for r in P.passages_stage(spark, near_copies, "").collect()) == want


def test_pipeline_stages(spark, small):
    import corpus_pipeline as P

    docs = table(spark, small, "documents")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(P.STAGES):
        after = stage(spark, before, small)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{i}"
        after.write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        rows, ids = after.collect(), {r["doc_id"] for r in before.collect()}
        assert rows and {r["doc_id"] for r in rows} <= ids, name
        if i < 4:
            assert after.columns == columns, name
        texts = {r["doc_id"]: r["text"] for r in before.collect()}
        if i == 0:
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in quality_rules.score(before).where("kept")
                .collect()}
        if i == 1:
            order = sorted(texts)
            groups = plain_groups([texts[d] for d in order], 5, 80)
            assert {r["doc_id"] for r in rows} == {d for j, d in enumerate(order) if groups[j][1] == j}
        if i == 2:
            order = sorted(texts)
            want = {d: x for d, x in zip(order, plain_strip([texts[d] for d in order], P.PASSAGE), strict=True)
                if x[1] < x[0] or not x[0]}
            assert {r["doc_id"]: r["text"] for r in rows} == {d: texts[d] if not x[1] else x[2] for d,
                x in want.items()}
        if i == 4:
            v = sentence_pieces.vocabulary(sentence_pieces.read_model())
            assert all(v.decode(r["token_ids"]) == r["text"] for r in rows)
        before = after
    assert P.run(spark, small).count() == before.count()

