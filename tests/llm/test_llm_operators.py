"""The training-data operators on small fixtures, against brute force and the tokenizers' own libraries."""

import hashlib
import pickle
import random
import time
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from compare import difference, duck  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from litsearch.llm import (  # noqa: E402
    context_tree, lattice_dedup, ngram_join, packing, pii, piece_encoding, resharding, toxicity, url_filter, winnowing)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, entries string, n_links int, node long, size long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, repeated and long texts, and columns whose names the operators use."""
    words = " ".join(f"word{i % 97} of{i % 13}" for i in range(4000))
    return documents(spark, [None, "", " ", "a", "one two three", "one two three", words, words + " end", "x" * 9000,
                             "mail me a.b@c.example.com or +1 (489) 555-0950, 10.0.0.300"])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(300, 8)) * 2
    got = lattice_dedup.decode(y)
    assert np.allclose(2 * got, np.rint(2 * got)) and (np.abs(got.sum(1)) % 2 < 1e-9).all()
    near = ((y[:, None] - (got[:, None] + lattice_dedup._roots()[None])) ** 2).sum(2).min(1)
    assert (((y - got) ** 2).sum(1) <= near + 1e-9).all()


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + 0.06 * rng.normal(size=16)).tolist(), i % 2) for i in range(150)]
    rows += [(150, rows[0][1], 0), (151, rows[0][1], None), (152, None, 0), (153, [0.0] * 16, 0),
             (154, [float("nan")] * 16, 0), (155, [None] * 16, 0), (156, [], 1), (157, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in lattice_dedup.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    links, root = {r[0]: set() for r in rows}, {r[0]: r[0] for r in rows}
    fine = [r for r in rows if r[0] < 151]
    for a in fine:
        for b in fine:
            if a[0] < b[0] and a[2] == b[2]:
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    for _ in rows:
        root = {k: min([root[k], *(root[x] for x in links[k])]) for k in root}
    assert {k: (len(links[k]), root[k]) for k in root} == {k: (r.n_links, r.component_id) for k, r in got.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_jaccard_classes_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for edits in (0, 0, 1, 2, 3, 5, 9):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [None, "", "one two", "one two", "ONE  two", "one two three"]
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(documents(spark, texts)).collect()}

    def items(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}
    sets = [items(t) for t in texts]
    links = [{j for j in range(len(sets)) if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(len(sets))]
    root = list(range(len(sets)))
    for _ in root:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(root))]
    assert [(got[i].n_links, got[i].class_id, got[i].kept) for i in range(len(sets))] == [
        (len(links[i]), root[i], root[i] == i) for i in range(len(sets))]


def test_near_copies_without_id_link(spark):
    words = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(words), " ".join([*words[:199], "new"]), " ".join([*words[:198], "two", "new"])
    other = " ".join(f"v{i}" for i in range(200))
    rows = [(None, a), (None, b), (7, c), (None, other), (None, other + " end"), (8, "x y"), (8, "x y")]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), (r.class_id or 0), r.n_links, r.kept) for r in got) == [
        (0, 0, 1, False), (0, 0, 1, True), (0, 7, 2, False), (0, 7, 2, False), (7, 7, 2, True), (8, 8, 1, False), (8, 8, 1, True)]


def test_tiles_by_shingles_lose_no_link(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = [*words[:110], *(f"n{rng.randrange(9999)}" for _ in range(4)), *words[114:]] if i % 4 == 0 else words
        rows.append((i, " ".join([*words, f"end{i}"])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, ngram_join.jaccard_classes(frame).collect()))
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 300)
    assert sorted(map(tuple, ngram_join.jaccard_classes(frame).collect())) == whole
    assert any(r[2] for r in whole)


def test_winnowing_counts_a_length_once_a_text(spark):
    """Conditions of a filter are evaluated for every element: no text may be measured in one."""
    plan = winnowing.compare_edited(documents(spark, ["some text " * 30, "another text " * 20]))._jdf.queryExecution().optimizedPlan().toString()
    entry_compared = re.compile(r"& 2147483647\) as int\) [<>]= \(*(char_)?length\(")
    assert "2147483647) as int) >=" in plan
    assert not entry_compared.search(plan)


def test_winnowing_deals_ranges_out_in_turn_and_writes_few_files(spark):
    """No task gets more ranges than the others, and not every one of them writes a file."""
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        texts = [f"text {i} " * (i % 7) for i in range(300)]
        out = winnowing.compare_edited(documents(spark, texts))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got, files = out.collect(), out.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.n_chars for r in got} == {i: len(t) for i, t in enumerate(texts)} and len(got) == 300
    assert files <= max(8, 2 * spark.sparkContext.defaultParallelism)
    assert plan.count("Exchange ") == 2 and not re.search(r"hashpartitioning\(range", plan)


def test_jaccard_join_starts_one_worker_a_task_and_writes_few_files(spark, monkeypatch):
    """An executor's memory holds one Python worker per task, and no file per empty shuffle partition."""
    import litsearch.llm.common as common

    plans, files, write = [], {}, common.stored

    def watched(df, name, *how):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = write(df, name, *how)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "stored", watched)
    monkeypatch.setattr(ngram_join, "stored", watched)
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        texts = [" ".join(f"w{g}x{i}" for i in range(40)) + f" end{c}" for g in range(40) for c in range(3)]
        got = ngram_join.jaccard_classes(documents(spark, texts)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.class_id for r in got} == {i: i // 3 * 3 for i in range(120)}
    assert not [p for p in plans if "ArrowEvalPython" in p and "MapInArrow" in p]
    most = 2 * spark.sparkContext.defaultParallelism
    assert max(n for name in ("sets", "agreeing", "candidates", "inside", "classes") for n in files[name]) <= most


def test_forest_prefix_is_shortened_to_the_target():
    d = ngram_join.prefix_depth()
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.TARGET
    assert 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES < ngram_join.TARGET


def _winnow(spark, text, k=8, w=32):
    grams = spark.createDataFrame([(i, text[i : i + k].encode("utf-32-be")) for i in range(max(1, len(text) - k + 1))], "i int, b binary")
    h = [r.h for r in grams.orderBy("i").select(F.hash("b").alias("h")).collect()]
    out = []
    for s in range(max(1, len(h) - w + 1)):
        low = min(h[s : s + w])
        at = s + max(i for i, x in enumerate(h[s : s + w]) if x == low)
        if not out or out[-1] != (low, at):
            out.append((low, at))
    return out


@pytest.mark.parametrize("text", ["abc", "a" * 200, "".join(random.Random(5).choice("ab cé中") for _ in range(4200))])
def test_winnowing_matches_its_definition(spark, text):
    got = winnowing.fingerprint(documents(spark, [text])).first()
    assert [(e["hash"], e["position"]) for e in got["entries"]] == _winnow(spark, text)


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.choice([0, 1, 7, 38, 39, 40, 77, 79, 90, 300]))) for _ in range(60)]
    rows = {r.doc_id: r for r in winnowing.compare_edited(documents(spark, texts)).collect()}
    edited = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + texts[i - 1][:half])
        assert rows[i].edited_sha256 == hashlib.sha256(edited[-1].encode()).hexdigest() and rows[i].n_chars == len(t)
    whole = {r.doc_id: r.fingerprint for r in winnowing.fingerprint(documents(spark, edited)).collect()}
    assert whole == {i: r.edited_fingerprint for i, r in rows.items()}


def test_packing_matches_the_tokenizer(spark, odd):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = packing.pack_power_of_two(odd, path).collect()
    tokenizer = Tokenizer.from_file(path)
    for doc in odd.collect():
        ids = [*tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == doc.doc_id), key=lambda r: r.start)
        assert [i for r in mine for i in r.ids] == ids and all(r.doc_tokens == len(ids) for r in mine)
        assert all(r.length == len(r.ids) <= 2048 and r.length & (r.length - 1) == 0 for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_pieces_match_the_library(spark, odd):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    signs = list("aAbtThe   '.,!09\n\t▁éß中👍\x85") + ["the", "  ", "\r\n"]
    frame = odd.select("doc_id", "text").unionAll(spark.createDataFrame(
        [(100 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(600, " " * 5000 + "x")],
        "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    for r in piece_encoding.encode_pieces(frame, path).collect():
        ids = model.encode(texts[r.doc_id])
        assert r.ids == ids and r.decoded == model.decode(ids)


def test_base_spans_match_the_plain_rules():
    rng = random.Random(8)
    parts = ["a.b", "@", "c.com", ".", "x", "1", "12", "255", "300", "4111111111111111", "-", " ", "+", "(", ")", "0", "@@", "4111 1111 1111 1111"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = pii.base_spans(t)
        assert got["email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert got["ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
                             if all(int(p) <= 255 for p in m.group().split("."))]


def test_pii_adds_looser_forms_and_keeps_base_spans(spark):
    rng = random.Random(9)

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))
    calm = " the of and that river stone window "
    texts = []
    for i in range(300):
        finds = [f"+1 ({rng.randint(200, 989)}) 555-{rng.randint(1000, 9999)}", card(), f"n{i}@mail{i % 9}.example.com",
                 f"{rng.randint(1, 200)}.{rng.randint(0, 255)}.3.4"]
        texts.append("the of" + calm + (calm * 2).join(finds) + calm + f"order {rng.randint(10**7, 10**9)} of 2024-01-02")
    texts += [None, ""]
    rows = sorted(pii.find_pii(documents(spark, texts)).collect(), key=lambda r: r.doc_id)
    for r, t in zip(rows, texts):
        assert {(s.kind, s.begin, s.end) for s in r.base} <= {(s.kind, s.begin, s.end) for s in r.found}
        if t:
            assert [s.kind for s in r.found] == ["phone", "card", "email", "ip"] or sorted(s.kind for s in r.found) == sorted(pii.KINDS)
    assert rows[300].redacted is None and rows[301].redacted == ""


def test_pii_sample_is_per_kind_and_of_different_finds(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 10)
    texts = [f"write n{i}@mail.example.com now" + "x" * (i % 20) for i in range(300)] * 2 + ["pay 4111111111111111 now"] * 300
    rows = [(k, y, tuple(f)) for k, y, f in pii.sampled(documents(spark, texts))]
    assert len(set(rows)) == len(rows)
    assert sum(r[:2] == ("email", 1) for r in rows) == 10 and sum(r[:2] == ("card", 1) for r in rows) == 1


def test_looser_forms_that_the_corpus_holds_are_found(spark):
    rng = random.Random(13)
    texts = []
    for i in range(600):
        number = f"{rng.randint(200, 989)}) 555-{rng.randint(1000, 9999)}"
        finds = [f"call +1 ({number}", f"write n{i}@mail{i % 9}.example.com", f"order {rng.randint(10**7, 10**9)} of 2024-01-02",
                 f"call ({number}", f"write n{i}(at)mail{i % 9}.example.com", "look at home.then"]
        texts.append("the river of that and " + " and the stone window of ".join(finds) + " at the end")
    model = pii.train(pii.sampled(documents(spark, texts)))
    for t in texts[:50]:
        found = [t[b:e] for _, b, e in model.spans(t)]
        assert any("(at)" in f for f in found) and sum("555" in f for f in found) == 2 and not any("2024" in f or "home" in f for f in found)


def _looser(rng, kind, words, true):
    """A looser form of the kind: personal data, or the same form with what is none."""
    if kind == "phone":
        return f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    if kind == "card":
        digits = str(rng.randint(4 * 10**15, 5 * 10**15 - 1))
        while pii.luhn(digits) != true:
            digits = str(rng.randint(4 * 10**15, 5 * 10**15 - 1))
        return rng.choice("./_").join(digits[i : i + 4] for i in range(0, 16, 4))
    if kind == "ip":
        return rng.choice(["[.]", "(.)"]).join(str(rng.randint(1, 255) if true or i != 1 else rng.randint(256, 999)) for i in range(4))
    if true:
        return f"{rng.choice(words)}{rng.randint(1, 99)}(at)mail{rng.randint(1, 9)}.example.com"
    return f"{rng.choice(words)} at {rng.choice(words)} dot {rng.choice(words)}"


def test_looser_forms_learned_from_documents(spark):
    model = pii.train(pii.sampled(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    found = {t: [k for k, _, _ in model.spans(t)] for t in (
        "call (489) 555-0950 now", "write joe.doe(at)mail3.example.com", "the river of 2024-01-02 and that is at the end. Of it")}
    assert list(found.values()) == [["phone"], ["email"], []]
    assert pii.redact("call (489) 555-0950 now", [("phone", 5, 19)]) == "call [PHONE] now"
    # the same forms filled with what is no personal data are refused, whatever the words around
    rng, words = random.Random(21), "river total part stone window garden music other story between table green".split()
    for kind in pii.KINDS:
        taken = {True: 0, False: 0}
        for _ in range(200):
            for true in taken:
                ahead = " ".join(rng.choice(words) for _ in range(12))
                ahead += rng.choice([" section", " version", " order"]) if kind == "phone" and not true else ""
                text = f"{ahead} {_looser(rng, kind, words, true)} {rng.choice(words)} {rng.choice(words)}"
                assert kind != "phone" or pii.candidates(text)
                taken[true] += any(k == kind for k, _, _ in model.spans(text))
        assert taken[False] <= 4 and taken[True] >= 130, (kind, taken)


def test_pii_on_a_million_digits_is_linear():
    model = pii.PiiModel(pii.BoostedTrees(), {}, {})
    start = time.time()
    for text in ("7" * 1_000_000, "7." * 500_000, "7 " * 500_000, "x" * 1_000_000):
        model.spans(text)
    assert time.time() - start < 8


def test_toxicity_on_held_out_sentences(spark):
    rng = random.Random(10)
    calm = ["the", "river", "story", "window", "garden", "running", "thin", "other", "stone", "music"]
    rude = ["idiot", "moron", "worthless", "pathetic"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(40)]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(40)] = rng.choice(rude)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    rows += [(400, None), (401, ""), (402, "the river i d i o t stone"), (403, "such an id-iot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[i].predicted == y for i, y in labels if got[i].held_out) and sum(got[i].held_out for i, _ in labels) > 50
    assert (got[400].predicted, got[401].predicted, got[402].predicted, got[403].predicted) == (0, 0, 1, 1)


def test_toxicity_looks_at_the_words_of_many_texts_together(monkeypatch):
    """The kernel works on arrays: one call of it per text costs more than its work."""
    rng = random.Random(14)
    model = toxicity.train([(f"word{i} plain text of words", 0) for i in range(40)] + [(f"word{i} you silly idiot", 1) for i in range(40)])
    texts = [None, "", " 12 "] + [" ".join("".join(rng.choices("abcdiot", k=rng.randint(1, 30))) for _ in range(8)) for _ in range(200)]
    alone = []
    for text in texts:
        by_itself = pickle.loads(pickle.dumps(model))
        words = toxicity.words_of(text or "")
        by_itself.learn(words)
        alone.append(by_itself.probability(by_itself.margin(words)))
    calls, triples = [], toxicity.triples
    monkeypatch.setattr(toxicity, "triples", lambda words: calls.append(len(words)) or triples(words))
    assert model.probabilities(texts) == alone
    assert len(calls) <= 1 + sum(calls) // toxicity.BLOCK
    assert model.probabilities([None]) == alone[:1] and model.probabilities(["", None]) == alone[1::-1] and model.probabilities([]) == []
    monkeypatch.setattr(toxicity, "TOGETHER", 100)
    assert pickle.loads(pickle.dumps(model)).probabilities(texts) == alone


def test_one_long_text_does_not_empty_the_toxicity_sample(spark):
    rows = [(i, f"text number {i}") for i in range(60)] + [(i, "x" * 300_000) for i in range(60, 70)] + [(3, "another"), (4, "text number 4")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    got = toxicity.sample_labelled(docs, labels)
    assert len(got) == len(learned) and {y for _, y in got} == {0, 1}
    # each class has its own characters; a text that does not fit is passed over alone
    few = toxicity.sample_labelled(docs, labels, chars=100, longest=1_000_000)
    assert sum(len(t) for t, _ in few) <= 100 and all(sum(len(t) for t, z in few if z == y) > 35 for y in (0, 1))
    # what one class leaves goes to the other
    one = toxicity.sample_labelled(docs.where("doc_id % 2 = 0 or doc_id = 1"), labels, chars=300)
    assert sum(len(t) for t, y in one if y == 0) > 200
    assert toxicity.sample_labelled(docs.limit(0), labels) == []


def test_rewriting_keeps_every_row_once(spark, tmp_path):
    texts = ["t" * (i % 50) for i in range(600)] + ["copy"] * 200
    docs = spark.createDataFrame([(None if i % 3 else i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    keyed = resharding.with_row_key(docs)
    plan = resharding.reshard(keyed, 6, row_col="row_key")
    touched = resharding.rewrite_affected(keyed, plan, str(tmp_path / "shards"))
    written = spark.read.parquet(str(tmp_path / "shards"))
    place = {r.row_key: r.shard for r in plan.collect()}
    expected = sorted((r.doc_id or -1, r.text, place[r.row_key]) for r in keyed.collect() if place[r.row_key] in touched)
    assert sorted((r.doc_id or -1, r.text, r.shard) for r in written.collect()) == expected
    assert touched == list(range(6)) and len(expected) == 800


def test_resharding_moves_least_and_balances(spark, odd):
    flow = resharding.min_cost_flow([50, 30, 20], [25, 25, 25, 25], lambda i, j: int(i != j))
    assert sum(flow.values()) == 100 and sum(v for (i, j), v in flow.items() if i != j) == 30
    docs = documents(spark, ["t" * (i % 50) for i in range(3000)] + ["copy"] * 1000)
    rows = resharding.reshard(docs, 8).collect()
    sums = {}
    for r in rows:
        sums.setdefault(r.shard, []).append(r)
    sizes = [sum(r["size"] for r in s) for s in sums.values()]
    assert len(rows) == 4000 and max(sizes) - min(sizes) < 500
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in sums.values())
    assert resharding.reshard(odd, 8).count() == 10


def test_context_tree_scores(spark, odd):
    docs = documents(spark, [f"Some words of number {i % 7} and more of them" for i in range(300)] + [None, "", "unseen"])
    rows = {r.doc_id: r for r in context_tree.score_documents(docs).collect()}
    texts = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = {}
    for i in train:
        for w in [*texts[i], "\n"]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, r in rows.items():
        tokens = [*texts[i], "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in counts for w in tokens), n)
        assert abs(r.base_score - sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens)) < 1e-6
    assert rows[300].score == 0 and rows[0].bits_per_byte < 1 < rows[302].bits_per_byte


#: A small context tree of three bytes of five bits as one dense table, to compare with.
DEPTH, FOLD, SYMBOLS = 3, 5, 256
CONTEXTS = 1 << (FOLD * DEPTH)


def codes(text: bytes) -> np.ndarray:
    """Context and byte of every position, as one number below CONTEXTS * 256."""
    b = np.frombuffer(text, np.uint8).astype(np.int64)
    out = b.copy()
    folded = b & ((1 << FOLD) - 1)
    for back in range(1, DEPTH + 1):
        if len(b) > back:
            out[back:] |= folded[:-back] << (8 + FOLD * (back - 1))
    return out


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    def lg(x):  # log gamma(x + 1/2) - log gamma(1/2), by Stirling's series from x + 8
        y = x + 8.5
        value = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
        for k in range(8):
            value = value - np.log(x + 0.5 + k)
        return value - 0.5723649429247001

    def factorial(x):
        y = x + 9.0
        value = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
        for k in range(8):
            value = value - np.log(x + 1.0 + k)
        return value

    z, o = zeros.astype(np.float64), ones.astype(np.float64)
    return lg(z) + lg(o) - factorial(z + o)


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of the 255 decision nodes of every context, from counts per byte."""
    zeros = np.zeros((len(counts), SYMBOLS), np.int64)
    ones = np.zeros_like(zeros)
    for depth in range(8):
        width = SYMBOLS >> depth
        sums = counts.reshape(len(counts), 1 << depth, 2, width // 2).sum(3)
        zeros[:, (1 << depth) : (2 << depth)] = sums[:, :, 0]
        ones[:, (1 << depth) : (2 << depth)] = sums[:, :, 1]
    return zeros, ones


def weighted_table(counts: np.ndarray) -> np.ndarray:
    """log10 probability of every byte in every deepest context, from counts [CONTEXTS, 256].

    Worked off one newest context byte at a time, so that memory stays small; the root joins them.
    """
    step = 1 << FOLD
    by_newest = counts.reshape(-1, step, SYMBOLS)  # [older bytes, newest byte, symbol]
    out = np.zeros((by_newest.shape[0], step, SYMBOLS), np.float32)
    log_half = np.log(0.5)
    root_children = np.zeros(SYMBOLS)
    kept = []
    for newest in range(step):
        levels, level = [], by_newest[:, newest]  # deepest contexts with this newest byte
        while True:
            levels.append(level)
            if len(level) == 1:
                break
            level = level.reshape(step, -1, SYMBOLS).sum(0)  # drop the oldest byte
        log_p, ratios, chances = None, [], []
        for depth, level in enumerate(levels):
            zeros, ones = _bits(level)
            kt = _log_kt(zeros, ones)
            chances.append(((ones + 0.5) / (zeros + ones + 1.0)).astype(np.float32))
            if depth == 0:
                log_p = kt
            else:
                children = log_p.reshape(step, -1, SYMBOLS).sum(0)
                ratios.append(np.clip(kt - children, -60, 60))
                log_p = np.logaddexp(log_half + kt, log_half + children)
        root_children += log_p[0]
        kept.append((chances, ratios))
    zeros, ones = _bits(counts.sum(0)[None, :])
    root_ratio = np.clip(_log_kt(zeros, ones) - root_children, -60, 60)
    root_chance = (ones + 0.5) / (zeros + ones + 1.0)
    for newest, (chances, ratios) in enumerate(kept):
        one = chances[0].astype(np.float64)  # [deepest contexts, node]
        for chance, ratio in zip(chances[1:], ratios, strict=True):
            many = len(one) // len(chance)
            share = 1 / (1 + np.exp(-np.tile(ratio, (many, 1))))
            one = share * np.tile(chance, (many, 1)) + (1 - share) * one
        share = 1 / (1 + np.exp(-root_ratio))
        one = share * root_chance + (1 - share) * one
        log_one, log_zero = np.log10(one), np.log10(1 - one)
        total = np.zeros((len(one), SYMBOLS))
        byte = np.arange(SYMBOLS)
        for depth in range(8):
            node = (1 << depth) | (byte >> (8 - depth))
            bit = (byte >> (7 - depth)) & 1
            total += np.where(bit, log_one[:, node], log_zero[:, node])
        out[:, newest] = total
    return out.reshape(CONTEXTS, SYMBOLS)


def test_context_tree_table_is_a_distribution():
    counts = np.zeros((CONTEXTS, 256), np.int64)
    np.add.at(counts.reshape(-1), codes(b"abracadabra " * 50), 1)
    table = 10.0 ** weighted_table(counts).astype(np.float64)
    assert np.allclose(table.sum(1), 1, atol=1e-3)
    code = codes(b"abrac")[-1]
    assert table.reshape(-1)[code] > 0.3


def test_context_tree_of_whole_bytes(spark):
    """The rows of Spark give the dense table's probabilities; contexts are longer than three bytes and not folded."""
    rng = random.Random(11)
    text = "".join(rng.choice(["abra", "cad", "bra", "zed"]) for _ in range(300)).encode()
    counts = np.zeros((CONTEXTS, 256), np.int64)
    np.add.at(counts.reshape(-1), codes(text), 1)
    dense = weighted_table(counts).reshape(-1)
    code, n = np.unique(context_tree.long_codes(text, 3), return_counts=True)
    frame = spark.createDataFrame(list(zip(code.tolist(), n.tolist())), "code long, n long")
    got = {r.code: r.value for r in context_tree.log_chances(frame, 3).collect()}
    for a, b in zip(codes(text)[3:], context_tree.long_codes(text, 3)[3:]):
        assert abs(got[int(b)] - dense[a]) < 1e-5
    # what follows "xxx" depends on the fifth byte back; 2 and r, space and @ share their low five bits
    rows = [f"{a}xxxx{b}" for a, b in (("p", "m"), ("q", "n"))] * 200 + ["2!", "r?", " !", "@?"] * 100
    right = ["pxxxxm", "2!", "@?"]
    wrong = ["pxxxxn", "2?", "@!"]
    docs = spark.createDataFrame([(None, t) for t in rows] + [(i, t) for i, t in enumerate(right + wrong, 1000)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in context_tree.score_documents(docs).where("doc_id is not null").collect()}
    assert all(score[1000 + i] > score[1003 + i] + 1 for i in range(3))


def test_context_tree_equals_a_recursion_and_blocks_change_nothing(spark, odd, monkeypatch):
    """Scores are those of the definition, written as a recursion over whole counts; small blocks, with texts
    cut into many pieces, give the same."""
    from math import log

    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "ra", "kad ", "\u00e9"]) for _ in range(rng.randrange(60))) for _ in range(40)] + ["", "ab" * 300]
    docs = documents(spark, texts)
    order, nodes, children = context_tree.ORDER, {}, {}
    for i, text in enumerate(texts):
        raw = text.encode()
        for at, byte in enumerate(raw):
            before = tuple(raw[at - j] if at >= j else -1 for j in range(1, order + 1))
            for k in range(8):
                for depth in range(order + 1):
                    key = (1 << k | byte >> (8 - k), before[:depth])
                    count = nodes.setdefault(key, [0, 0])
                    count[byte >> (7 - k) & 1] += zlib.crc32(str(i).encode()) % 7 != 2
                    if depth:
                        children.setdefault((key[0], before[: depth - 1]), set()).add(key)

    def estimate(key):
        zeros, ones = nodes[key]
        return sum(log(j + 0.5) for j in range(zeros)) + sum(log(j + 0.5) for j in range(ones)) - sum(log(j + 1) for j in range(zeros + ones))

    weighted = {}
    for key in sorted(nodes, key=lambda key: -len(key[1])):
        below = sum(weighted[c] for c in children.get(key, ()))
        weighted[key] = estimate(key) if len(key[1]) == order else np.logaddexp(estimate(key), below) - log(2)

    def chance(node, before, depth):
        zeros, ones = nodes[node, before[:depth]]
        here = (ones + 0.5) / (zeros + ones + 1)
        if depth == order:
            return here
        share = np.exp(estimate((node, before[:depth])) - log(2) - weighted[node, before[:depth]])
        return share * here + (1 - share) * chance(node, before, depth + 1)

    got = {r.doc_id: r.score for r in context_tree.score_documents(docs).collect()}
    for i in [0, 3, 7, 40, 41]:
        raw, score = texts[i].encode(), 0.0
        for at, byte in enumerate(raw):
            before = tuple(raw[at - j] if at >= j else -1 for j in range(1, order + 1))
            for k in range(8):
                one = chance(1 << k | byte >> (8 - k), before, 0)
                score += np.log10(one if byte >> (7 - k) & 1 else 1 - one)
        assert abs(got[i] - score) < 1e-4, (i, got[i], score)
    whole = {r.doc_id: r.score for r in context_tree.score_documents(odd).collect()}
    monkeypatch.setattr(context_tree, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(context_tree, "BUCKET_BYTES", 400)
    pieces = {r.doc_id: r.score for r in context_tree.score_documents(odd).collect()}
    assert whole.keys() == pieces.keys() and all(abs(whole[i] - pieces[i]) < 1e-3 for i in whole)


def test_pipeline_stages_decide_on_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    calm = ["the", "river", "story", "window", "garden", "running", "thin", "other", "stone", "music"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(calm) for _ in range(40)]
        if i % 3 == 0:
            words[rng.randrange(40)] = "idiot"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows += [(401, "such an idiot"), (401, "the river of 401"), (None, "an idiot again"), (None, "the river of none")]

    def through(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert through(corpus_pipeline.toxicity, rows) == sorted((r for r in rows if "idiot" not in r[1]), key=repr)

    words = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(words), " ".join([*words[:199], "new"]), " ".join([*words[:198], "two", "new"])
    lone = [(7, "alone under the id of a near copy"), (None, "alone without an id here")]
    twice = [(9, "a row that is there twice")]
    nameless = " ".join(f"v{i}" for i in range(200))
    rows = [(8, a), (7, b), (3, c), (None, b), *lone, *twice, *twice, (None, nameless), (None, nameless + " end")]
    got = through(corpus_pipeline.ngram_join, rows)
    assert [r for r in got if not (r[1] or "").startswith("v0 ")] == sorted([(3, c), *lone, *twice], key=repr)
    assert len(got) == 5


def test_urls(spark):
    urls = [None, "no scheme", "https://www.Cheap-Pills.example.org/en/1", "http://a.example.net/en/x?q=1", "http://example.net/de/",
            "http://x.example.com/de/1#t", "http://example.org/fr/2", "http://notexample.net", "http://spam-farm.example.com", "http://a.com/login"]
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("www.cheap-pills.example.org", "/en/1", None, "block"),
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"),
        ("x.example.com", "/de/1", "example.com/de/", "block"), ("example.org", "/fr/2", "org/fr/", "allow"),
        ("notexample.net", "", None, "allow"), ("spam-farm.example.com", "", None, "block"), ("a.com", "/login", None, "block")]


def test_every_matching_pattern_rule_is_fetched(spark):
    """Against every regular expression on every URL, without any index."""
    urls = ["http://porn.a.io/", "http://xxx.a.io/", "http://ad.a.io/ads", "http://ads.a.io", "http://adserver.a.io", "http://banner.a.io",
            "http://banners.a.io", "http://a.io/signin", "http://a.io/wp-login.php", "http://a.io/x;jsessionid=1", "http://a.io/?PHPSESSID=1",
            "http://spamfarm.com/", "http://spamfarm.com/farm/", "http://spam-farm.com/", "http://xxx.porn.a.io/login?jsessionid=1"]
    urls += ["http://a.io/farm/spam", "http://farm.a.io/", "http://a.io/porn", "http://a.io/ads/banner"] + ["http://farm.b.io/farm"] * 5
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.patterns, r.verdict) for r in url_filter.judge_urls(frame, host_rules=[("none.io/", "block")]).orderBy("page_id").collect()]
    want = [sorted(n for n, p, _ in url_filter.PATTERN_RULES if re.search(p, u.lower())) for u in urls]
    assert got == [(w, "block" if w else "allow") for w in want] and all(want[:15]) and not any(want[15:])


def test_sql_agrees(spark):
    from litsearch.llm.queries import ORACLES, QUERIES

    con = duck(SF)
    for name, sql in ORACLES.items():
        assert difference(QUERIES[name](spark, SF), con, sql) is None


def test_empty_tables(spark):
    none = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for frame in (packing.pack_power_of_two(none, P.path("word_bpe_49k.json")), piece_encoding.encode_digests(none, P.path("piece_bpe_32k.model")),
                  winnowing.compare_edited(none), ngram_join.jaccard_classes(none), pii.find_digests(none), toxicity.score_toxicity(none, labels),
                  resharding.reshard(none, 8), context_tree.score_documents(none),
                  lattice_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
                  url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"))):
        assert frame.count() == 0


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for frame in (piece_encoding.encode_digests(odd, P.path("piece_bpe_32k.model")), winnowing.compare_edited(odd), ngram_join.jaccard_classes(odd),
                  pii.find_digests(odd), toxicity.score_toxicity(odd, labels), context_tree.score_documents(odd)):
        assert frame.count() == 10
