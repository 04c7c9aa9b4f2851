"""Each operator against a brute-force version, and on the awkward rows that every operator must take."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from streamworks.llm import bpe, chat, fingerprint, license, linededup, packing, pii, quality, simhash, topk
from streamworks.llm.queries import tokenizer_path

LONG = "word " * 30_000 + "end"
DOCS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda.\nSecond line is here for all of us today."),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda.\nSecond line is here for all of us today."),
    (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (6, "one"), (None, "a row without an id says a few words"), (None, None), (7, LONG), (8, "Mail a.b@c.de now"),
    (9, "x\ny\nx\ny\nx\ny"), (10, "ÀÉ <|endoftext|> ß Σ 日本 👍 \u0000 é"),
]
SCHEMA = "doc_id long, text string, id long, fp string, words int, features string, score string, spans string, range int, row string, piece int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*d, 1, "x", 2, "f", "s", "p", 3, "r", 4, "k") for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(spark, sf, n=400):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(n).collect()]


# --- top-k ---------------------------------------------------------------------------------------------------------


def brute_top(rows, k, every):
    vecs = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        vecs.setdefault(i, []).append([int(np.floor(256 * float(x))) for x in v])
    out = {}
    for q, own in vecs.items():
        if q % every:
            continue
        query = min(own)
        best = {i: max(sum(a * b for a, b in zip(query, v, strict=True)) for v in vs if len(v) == len(query)) for i, vs in vecs.items() if i != q and any(len(v) == len(query) for v in vs)}
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {(q, r + 1, i, -s) for q, found in out.items() for r, (s, i) in enumerate(found)}


def test_topk_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * (5 if i % 40 == 0 else 0.3) for _ in range(8)]) for i in range(600)]
    rows += [(600 + i, [0.5] * 8) for i in range(50)]  # ties
    rows += [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (None, [1.0] * 8), (703, []), (750, [1.0, 2.0]), (800, [2.0, 1.0]), (5, [9.0] * 8), (850, [0.0] * 8), (50, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, dim string, bucket int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=64, buckets=5, round_bytes=700)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5, 50)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize(("spread", "size"), [(50, 6), (3, 3), (10**9, 4), (20, 64)])
def test_pruning_never_loses(spread, size):
    """Whatever the block, the thresholds and the branch: the k best, ties to the smaller id."""
    rng = np.random.default_rng(spread)
    vecs = rng.integers(-spread, spread, (400, size))
    if size == 64:  # each near one of eight axes
        vecs[np.arange(400), rng.integers(0, 8, 400)] += 900
    queries = np.concatenate([vecs[:30] * (1 if spread > 10**6 else 2), rng.integers(-spread, spread, (20, size)), np.zeros((1, size), np.int64)])
    norms = np.sqrt((vecs.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    ids = rng.permutation(400)
    q_ids = np.concatenate([ids[:30], np.arange(1000, 1021)])
    own = topk.Best(q_ids, queries, np.full(len(queries), -np.inf), 5)
    for start in range(0, 400, 50):
        own.meet(ids[order[start : start + 50]], vecs[order[start : start + 50]])
    for i, q in enumerate(queries):
        want = sorted((-int(sum(int(a) * int(b) for a, b in zip(v, q, strict=True))), int(c)) for c, v in zip(ids, vecs, strict=True) if c != q_ids[i])[:5]
        assert sorted((-s, c) for c, s in own.found[i].items()) == want
    assert sum(n for n, _ in own.stats.values()) == 400 * len(queries)
    if size == 64:
        assert own.stats["by coordinates"][0] > 4 * own.stats["by coordinates"][1] > 0


def test_pruned_shares(spark):
    """Vectors of few directions: most pairs are left out, by both branches."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) ** 3 * (5 if i % 9 == 0 else 1) for _ in range(4)]) for i in range(2000)]
    got = {r.branch: (r.pairs, r.verified) for r in topk.pruned_shares(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=128).collect()}
    assert sum(n for n, _ in got.values()) == 40 * 2000 and sum(n for _, n in got.values()) < 40 * 2000 / 2


# --- quality -------------------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.measured(spark.read.parquet(f"{sf}/documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.with_score(found, quality.fit_on_labels(found, labels))
    rows = scored.join(labels, "doc_id").filter(quality.held_out()).select("score", "quality").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.93


def test_quality_awkward(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, None), (7, 5), (8, 1), (9, 0)], "doc_id long, quality int")
    found = quality.measured(docs)
    scored = quality.with_score(found, quality.fit_on_labels(found, labels)).collect()
    assert len(scored) == len(DOCS) and all(0 <= r.score <= 1 for r in scored)
    none = quality.fit_on_labels(found, labels.limit(0))
    assert {r[0] for r in quality.with_text_score(docs, none, out="p").select("p").collect()} == {0.5}
    assert quality.measured(empty).count() == 0
    assert quality.fit_on_labels(quality.measured(empty), labels).coef is None


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [0.0, 1.5, 3.5]  # equal neighbours are one pool


# --- fingerprints --------------------------------------------------------------------------------------------------


def slow_boundaries(raw):
    h, ends, start = 0, [], 0
    for i, b in enumerate(raw):
        h = ((h << 1) + int(fingerprint.GEAR[b])) & 0xFFFFFFFF
        size = i + 1 - start
        loose, strict = h & int(fingerprint.LOOSE) == 0, h & (int(fingerprint.LOOSE) | int(fingerprint.STRICT)) == 0
        if size == fingerprint.MOST or (size >= fingerprint.LEAST and loose and (strict or size >= fingerprint.NORMAL)):
            ends.append(i + 1)
            start = i + 1
    if start < len(raw):
        ends.append(len(raw))
    return ends


def test_boundaries_equal_a_byte_by_byte_roll():
    rng = random.Random(5)
    for n in (0, 1, 15, 16, 127, 128, 129, 5000):
        raw = bytes(rng.choice(b"abcdefgh etaoin") for _ in range(n))
        assert fingerprint.boundaries(np.frombuffer(raw, np.uint8)) == slow_boundaries(raw)
    assert fingerprint.boundaries(np.frombuffer(b"a" * 1000, np.uint8)) == slow_boundaries(b"a" * 1000)


def test_fingerprints_of_neighbours(spark, sf):
    rows = sorted(texts(spark, sf))
    got = {r.doc_id: r for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        new = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b = fingerprint.chunk_digests(t), fingerprint.chunk_digests(following)
        assert got[i].near_next == fingerprint.containment(a, b) and fingerprint.unpacked(got[i].fingerprint) == a
    long = [i for i, t in rows if len(t) > 2000]
    assert np.mean([got[i].near_edited for i in long]) > 0.6


def test_fingerprints_of_many_rows_of_one_id(spark):
    """A third of the rows has one id, another part none; each row's next is the one behind it in order of id, then text."""
    rows = [(7 if i % 3 == 0 else None if i % 7 == 0 else i, f"text {i * 7919 % 400} of some words {i % 5}") for i in range(400)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest() for (_, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_fingerprints_awkward(spark, docs, empty):
    got = fingerprint.with_next(docs).collect()
    assert len(got) == len(DOCS)
    same = [r.fingerprint for r in got if r.doc_id in (1, 2)]
    assert same[0] == same[1]
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert fingerprint.with_next(empty).count() == 0
    one = fingerprint.with_next(docs.filter("doc_id = 8")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    sets = fingerprint.fingerprints(docs, out="fp").select("fp", "_fp").collect()
    assert len(sets) == len(DOCS)


# --- line dedup ----------------------------------------------------------------------------------------------------


def brute_line_dedup(rows, least):
    """The rule as it stands: a line goes if some run of ``least`` words or more that holds it stands earlier too, and apart."""
    rows = [(i, t) for i, t in rows if t is not None]
    kinds = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows}, key=lambda r: r[:2])
    seqs = [[(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" ")] for _, _, t in kinds]
    seen, gone = {}, [set() for _ in kinds]
    for d, seq in enumerate(seqs):
        for q in range(len(seq)):
            total = 0
            for e in range(1, len(seq) - q + 1):
                total += len(seq[q + e - 1][1].strip(" ").split(" "))
                if total >= least:
                    seen.setdefault(tuple(x for _, x in seq[q : q + e]), []).append((d, q, e))
    for places in seen.values():
        for d, q, e in places[1:]:
            if (d, q) >= (places[0][0], places[0][1] + e):
                gone[d] |= {n for n, _ in seqs[d][q : q + e]}
    new = {}
    for (has, i, t), g in zip(kinds, gone, strict=True):
        new[(i if has else None, t)] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g)
    return new


@pytest.mark.parametrize("least", [1, 3, 6])
def test_line_dedup_equals_brute_force(spark, least):
    rng = random.Random(11 + least)
    lines = ["a", "b c", "d e f", "g h i j", "", "k l m n o p", "q"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    passage = [f"x{i} y" for i in range(50)]  # a maximal run of 50 lines, between others
    rows += [(300 + i, "\n".join([f"own {i}", *passage[i:], f"end {i}"])) for i in range(4)]
    rows += [(400 + i, "\n".join((["la la"] * 12, ["u v", "w"] * 9, ["m n o"] * 3 + ["p"] + ["m n o"] * 4, ["r", "s", "t"] * 7)[i])) for i in range(4)]
    rows += [(None, "a\nb c\nd e f\ng h i j"), (200, None), (201, ""), (5, rows[5][1])]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.col("text")), min_words=least)
    want = brute_line_dedup(rows, least)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == (None if r.old is None else want[r.doc_id, r.old]), (r.doc_id, r.old)


def test_line_dedup_keeps_first_copies_whole(spark):
    """Runs that repeat within one text, and a maximal run whose copy goes in one piece."""
    passage = [f"line {i} of a passage" for i in range(50)]
    rows = [(1, "\n".join(["la la"] * 12)), (2, "\n".join(["one a", "two b"] * 5)), (3, "\n".join([*passage, "after"])), (4, "\n".join(["before", *passage]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, min_words=10).collect()}
    assert got == {1: "\n".join(["la la"] * 5), 2: rows[1][1], 3: rows[2][1], 4: "before"}
    at = linededup.cut_lineage(linededup.repeated_lines(linededup.positions(df, "doc_id", "text")))
    levels = linededup.suffix_ranks(at)
    assert len(levels) == 6  # 32 <= 50 lines < 64
    copies = linededup.later_copies(linededup.least_intervals(at, levels, 10))
    runs = {(r.d.id, r.q, r.n) for r in linededup.maximal_runs(copies, levels).filter("d.id > 2").collect()}
    assert runs == {(4, 1, 50)}


def test_line_dedup_awkward(spark, docs, empty):
    got = linededup.dedup_lines(docs, out="n", min_words=10).collect()
    assert len(got) == len(DOCS) and got[0].asDict().keys() == {*docs.columns, "n"}
    by = {r.doc_id: r for r in got}
    assert (by[1].n, by[2].n, by[2].text, by[9].n, by[3].text) == (0, 2, "", 0, None)
    assert linededup.dedup_lines(empty).count() == 0


# --- byte pairs ----------------------------------------------------------------------------------------------------

ALPHABET = [*"abcdefgtheiou'sTHE  \n\t\x1c   éèİΣßﬁ½²٣日本👍!?.,#9 0", "é", "<|endoftext|>", "<|startoftext|>", "'ll", "   ", " \n", "the", "ing"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(n)]


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib, (encoder, decoder) = Tokenizer.from_file(path), bpe.machines(path)
    rng = random.Random(1)
    long = ["".join(rng.choices("abcdeghilnorstu", k=4000)), "a" * 5000, "!" * 5000, "".join(rng.choices(["the", "ing", "tion", "a"], k=2000))]
    for t in [*odd_texts(1500, 2), *long]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t).tolist() == ids
        assert decoder.restart().feed(ids) + decoder.finish() == lib.decode(ids, skip_special_tokens=False)
    rows = bpe.round_trips(docs, path).collect()
    assert len(rows) == len(DOCS)
    want = sorted((str(i), len(ids := lib.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, t in DOCS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in rows) == want
    back = bpe.decode(bpe.encode(docs, path), path).select("text", "decoded").collect()
    assert all(r.decoded == lib.decode(lib.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in back)
    assert bpe.round_trips(docs.limit(0), path).count() == 0


def test_word_stream_is_stable_for_any_continuation():
    """Tokens that are out stay, whatever follows, and together they are the whole word's."""
    encoder, _ = bpe.machines(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(8)
    assert np.mean([encoder.ahead_of[t] <= bpe.WINDOW for t in encoder.vocab.values()]) > 0.5
    for n in range(400):
        pieces = rng.choice(["etaoinshrdlu", ["the", "ing", "tion", "ation", "s", "er"], "ab", "!?.", ["a"], [*"aeiou", "ß", "日本", "👍"]])
        word = "".join(rng.choices(pieces, k=rng.randint(1, 400))).encode()
        stream, out, at = bpe.WordStream(encoder), [], 0
        while at < len(word):
            step = rng.randint(1, 90)
            out += stream.feed(word[at : at + step])
            at += step
        early = len(out)
        out += stream.finish()
        assert out == encoder.merge([*(encoder.first[b] for b in word[:-1]), encoder.last[word[-1]]]), word
        assert early or len(word) < 1200


@pytest.mark.parametrize("block", [130, 200, 1000])
def test_transducer_equals_the_library(block):
    """Texts with and without white space, in blocks; most tokens are out before the end of the input."""
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib, (encoder, _) = Tokenizer.from_file(path), bpe.machines(path)
    rng = random.Random(block)
    marks = ["a" * 50, "!" * 70, "'s", "'", "re", "1234", "Éa", "e\u0301", "日本語", "<|endoftext|>", "ing", "ΣΣ", "\u1100\u1161\u11a8", "x", "'ll", "-", "\u0301"]
    texts_ = [" ".join(rng.choices(ALPHABET, k=3000)), "a" * 5000, "!" * 5000 + "x" * 3000 + "'s", "9" * 2000, "é" * 3000, "\u0301" * 500, " " * 3000 + "x"]
    texts_ += ["".join(rng.choices(marks, k=rng.randint(50, 400))) for _ in range(60)] + ["".join(rng.choices([*marks, " ", "\n"], k=300)) for _ in range(60)]
    for t in texts_:
        machine, out = bpe.Transducer(encoder, block), b""
        for i in range(0, len(t), 97):
            out += machine.feed(t[i : i + 97])
            assert t[0] == "\u0301" or len(machine.pending) <= block + 97 and len(machine.words) <= 4 * block
        early = len(out)
        out += machine.finish()
        assert np.frombuffer(out, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:200]
        assert early > 0.5 * len(out) or len(t) < 4 * block or t[0] in " \u0301"


def test_transducer_needs_little_memory():
    """A text of 2.8 million characters without any white space adds less than 20 MB, whatever its length: blocks are of 65536 characters."""
    import tracemalloc

    encoder, decoder = bpe.machines(tokenizer_path("word_bpe_49k.json"))
    text = "abcdefghij,.12" * 200_000
    bpe.round_trip(encoder, decoder, text[:100_000])
    tracemalloc.start()
    n, _, _ = bpe.round_trip(encoder, decoder, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 200_000 and peak < 20_000_000, peak


# --- chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["[INST]", "[/INST]", "\\", "</s>", "<s>", "[ROLE]", "[TEXT]", "[/ROLE]", "[SYS]", "[\\INST]", "<\\\\/s>", "a", "\n", "é", "[", "<", "/"]
    text = lambda: "".join(rng.choices(parts, k=rng.randint(0, 8)))
    rows = [(c, n, rng.choice(["user", "assistant", "system", "tool", "we[TEXT]ird", None, ""]), rng.choice([text(), text(), None])) for c in range(80) for n in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "x"), (3, None, "user", "first"), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = chat.format_conversations(chat.records_of_rows(df)).withColumn("back", chat.read_turns(F.col("formatted"))).collect()
    want = {}
    for c, n, r, t in rows:
        want.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    assert {g.conv_id: [(x.role, x.text) for x in g.back] for g in got} == {c: [x[2:] for x in sorted(v)] for c, v in want.items()}
    assert {g.layout for g in got} == {"turns"}
    assert chat.turn_digests(chat.format_conversations(chat.records_of_rows(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', "messages"),
        ('{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}', "shared"),
        ('{"prompt":"hi","completion":"yo"}', "prompt"), ('{"response":"yo","prompt":"hi"}', "answer"), ('{"instruction":"hi","output":"yo"}', "instruction"),
        ('{"what":"hi"}', None), ("not json", None), (None, None), ("", None),
    ]
    got = chat.format_conversations(spark.createDataFrame([(r,) for r, _ in records], "record string")).collect()
    assert {(g.record, g.layout) for g in got} == set(records)
    assert {g.formatted for g in got if g.layout} == {"[INST]hi[/INST]<s>yo</s>"}


def test_chat_layouts_with_other_fields(spark):
    """Extra fields, nulls, nested prompts, parts and odd first members don't hide a layout."""
    said = '"role":"user","content":"hi"},{"role":"assistant","content":"yo"'
    records = [
        ('{"id":7,"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo","weight":1}]}', "shared"),
        ('{"id":"a","source":"web","tools":[{"name":"x"}],"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}],"system":null}', "shared"),
        ('{"messages":[{"name":null,' + said + "}]}", "messages"), ('{"prompt":"hi","messages":[{' + said + ',"extra":{"deep":{"er":[1]}}}]}', "messages"),
        ('{"messages":[{},{' + said + "}]}", "messages"), ('{"data":{"prompt":"hi","completion":"yo","id":3}}', "nested prompt"), ('{"prompt":"hi","completion":"yo","input":null}', "prompt"),
        ('{"messages":[{"role":"user","content":[{"type":"text","text":"h"},{"type":"text","text":"i"}]},{"role":"assistant","content":"yo"}]}', "messages of parts"),
        ('{"prompt":"hi"}', None), ('{"messages":[]}', None), ('{"messages":{"role":"user","content":"x"}}', None), ("[1,2]", None),
    ]
    got = chat.format_conversations(spark.createDataFrame([(r,) for r, _ in records], "record string")).collect()
    assert {(g.record, g.layout) for g in got} == set(records)
    want = {"[INST]hi[/INST]<s>yo</s>", "[ROLE][TEXT][/ROLE][INST]hi[/INST]<s>yo</s>"}
    assert {g.formatted for g in got if g.layout} == want
    kind = "record struct<id:long,data:struct<prompt:string,completion:string>,messages:array<struct<role:string,content:array<struct<type:string,text:string>>,name:string>>>"
    rows = [((1, ("hi", "yo"), None),), ((2, None, [("user", [("text", "h"), ("text", "i")], None), ("assistant", [("text", "yo")], "n")]),), ((3, None, None),)]
    got = chat.format_conversations(spark.createDataFrame(rows, kind)).select("layout", "formatted").collect()
    assert [tuple(g) for g in got] == [("nested prompt", "[INST]hi[/INST]<s>yo</s>"), ("messages of parts", "[INST]hi[/INST]<s>yo</s>"), (None, None)]


def test_chat_structs_of_one_table(spark):
    """Rows of several layouts in one wide struct; a text beyond what JSON functions read."""
    kind = "record struct<prompt:string,completion:string,messages:array<struct<role:string,content:string>>,instruction:string>"
    rows = [(("hi", "yo", None, None),), ((None, None, [("user", "hi"), ("assistant", "yo")], None),), ((None, None, None, "hi"),)]
    got = chat.format_conversations(spark.createDataFrame(rows, kind)).select("layout", "formatted").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("prompt", "[INST]hi[/INST]<s>yo</s>"), ("messages", "[INST]hi[/INST]<s>yo</s>"), (None, None)]))
    long = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("abcdefghij"), 2_500_000).alias("text"))
    r = chat.turn_digests(chat.format_conversations(chat.records_of_rows(long))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (1, 25_000_000, hashlib.sha256(b"abcdefghij" * 2_500_000).hexdigest())


# --- licences ------------------------------------------------------------------------------------------------------


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    filler = ["lorem", "ipsum", "dolor", "license", "licensed", "the", "public", "version", "released"]
    names, rows, want = list(license.TEMPLATES), [], set()
    for i in range(120):
        parts = [rng.choice(filler) for _ in range(rng.randint(0, 70))]
        if i % 2:
            name = rng.choice(names)
            at = rng.randint(0, len(parts))
            own = license.TEMPLATES[name].split()
            parts[at:at] = [w.upper() + "!!" if i % 3 == 0 else w for w in own]
            want.add((i, name, at, at + len(own)))
        rows.append((i, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "!!! ..."), (503, LONG + " Released under the MIT License.")]
    want.add((503, "mit", 30_001, 30_006))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, template string, size int")
    got = {(r.doc_id, r.template, r.start_word, r.end_word) for r in license.scan(df).collect()}
    assert got == want
    assert license.scan(df.limit(0)).count() == 0


def test_license_occurrences_and_rows(spark):
    """Licences side by side, the same one many times, rows without ids, full texts with changes, no templates."""
    t, line = license.TEMPLATES, "the words between them are a few more than five of them"
    rows = [
        (1, f"{t['gpl-2.0']} {t['gpl-3.0']}"), (2, f"{t['gpl-2.0']}\n{line}\n{t['gpl-3.0']}"), (3, "\n".join((t["mit"], t["cc-by-4.0"], t["mit"]))), (4, "\n".join([t["apache-2.0"]] * 100)),
        (None, f"x {t['mit']}"), (None, t["cc-by-4.0"]), (None, None), (5, t["mit"]), (5, t["cc-by-4.0"]), (5, t["mit"]),
        (6, f"Copyright (c) 2020 someone {t['mit text']} {line} {t['bsd-3-clause text']}"), (7, t["gpl-3.0 header"].replace("redistribute", "copy").replace("useful", "handy")), (8, "\n".join(f"{k}: {v}" for k, v in t.items() if k.endswith("text"))),
    ]
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.start_word):
        by.setdefault(r.doc_id, []).append(r.template)
    assert by[1] == by[2] == ["gpl-2.0", "gpl-3.0"] and by[3] == ["mit", "cc-by-4.0", "mit"] and by[4] == ["apache-2.0"] * 100
    assert sorted(by[None]) == sorted(by[5]) == ["cc-by-4.0", "mit"] and by[6] == ["mit text", "bsd-3-clause text"] and by[7] == ["gpl-3.0 header"]
    assert by[8] == [k for k in t if k.endswith("text")]
    assert license.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates={}).count() == 0
    assert len(set(map(license.size_class, (len(license.words_of(x)) for x in t.values())))) >= 5


def test_license_bands_recall_without_the_filter_on_words(spark, monkeypatch):
    """What the bands alone retrieve: with every word an anchor, no planted template is missed."""
    rng, names = random.Random(3), list(license.TEMPLATES)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 300))]
        own = license.TEMPLATES[names[i % len(names)]].split()
        if len(own) > 100:  # 0.88 of the shingles stay at least
            own[len(own) // 2] = own[len(own) // 4] = "changed"
        at = rng.randint(0, len(words))
        rows.append((i, " ".join([*words[:at], *own, *words[at:]])))
    monkeypatch.setattr(license, "anchors", lambda found, *_: set(found) | {w for _, t in rows for w in license.words_of(t)})
    got = {(r.doc_id, r.template) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((i, names[i % len(names)]) in got for i in range(400)) >= 399


# --- personal data -------------------------------------------------------------------------------------------------


def brute_base(text):
    """The contract's patterns as they stand."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(9)
    parts = ["a@b.c", "@", ".", "+1 ", "555", "4111111111111111", " ", "-", "10.0.0.1", "256", "é", "x", "4111 1111 1111 1111", "(", "\n", "%", "0"]
    cases = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(4000)]
    for t in cases:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == brute_base(t), t
    for t, (base, both) in zip(cases, pii.find(cases, pii.default_field()), strict=True):
        assert set(base) <= set(both) and all(0 <= a < b <= len(t) for _, a, b in both)


def test_pii_awkward(spark, docs, empty):
    got = pii.span_digests(docs).collect()
    assert len(got) == len(DOCS)
    want = sorted((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(t or "")).encode()).hexdigest()) for i, t in DOCS)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    masked = {r.doc_id: r.text for r in pii.with_spans(docs, masked="text").select("doc_id", "text").collect()}
    assert masked[8] == "Mail <EMAIL> now" and masked[3] is None and masked[7] == LONG
    assert pii.span_digests(empty).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------


def check_packing(rows, spark, capacity, path, **options):
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, leaf string, fill int")
    got = packing.pack_documents(df, path, capacity=capacity, **options).collect()
    lib = Tokenizer.from_file(path)
    want, total = [], 0
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        cut = len(ids) % capacity or min(len(ids), capacity)
        starts = [0, *range(cut, len(ids), capacity)]
        for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want.append((str(i), p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), total


def test_packing(spark, sf):
    path = tokenizer_path("byte_bpe_50k.json")
    n, total = check_packing(texts(spark, sf), spark, 256, path)
    assert n <= 1.06 * total / 256 + 1
    check_packing(DOCS, spark, 64, path, fan_in=2)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    store, lib = packing.TextIds(path), Tokenizer.from_file(path)
    long = ["a" * 3000, " " * 500 + "x", "the" * 1000, "\u3000\u00a0\x85\x1f \n", "".join(map(chr, range(1, 0x500))), "".join(map(chr, range(0x2000, 0x2200)))]
    for t in [*odd_texts(3000, 12), *long]:
        assert np.frombuffer(store.of(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


# --- SimHash -------------------------------------------------------------------------------------------------------


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_equals_brute_force(spark, sf):
    rows = texts(spark, sf) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One Two"), (9004, "one two"), (9003, "One Two")]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp long, key string")).collect()
    fps = [brute_simhash(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], fps)
    want = sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comps, strict=True))
    assert sorted(map(tuple, got)) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("segments", "most"), [(3, 10_000), (5, 10_000), (6, 10_000), (3, 20)])
def test_links_find_chains_and_dense_groups(spark, segments, most):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(200)]
    chain = [fps[0]]
    for _ in range(12):  # neighbours differ by 4 bits, ends by many
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    dense = [fps[1] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(60)]
    fps = list(dict.fromkeys(fps + chain + dense))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 4, segments, most)).collect()}
    if most == 20:  # crowded keys are found, and all that are
        sizes = simhash.variants(df, 3, 4).groupBy("key_no", "key").count().filter("count > 20")
        assert sizes.join(simhash.crowded(df, 3, 4, 20), ["key_no", "key"], "left_anti").count() == 0 < sizes.count()
    got = {}
    for i, f in enumerate(signed):
        got.setdefault(roots.get(f, ("own", f)), set()).add(i)
    want = {}
    for i, c in enumerate(brute_components(list(range(len(fps))), fps)):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.segments_for(n) for n in (0, 10**6, 10**7, 10**9, 10**11)] == [3, 3, 5, 6, 7]


def test_simhash_awkward(docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(DOCS)
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
