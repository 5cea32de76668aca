"""The training-data operators against plain Python, on a small table with everything that goes wrong."""

import bisect
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import common, components, fingerprints, language_model, mixing, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_store, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "δέλτα", "中文", "e", "zeta.", "eta", "theta"]) + str(rng.randrange(60)) for _ in range(n))


def texts():
    rng = random.Random(11)
    passage = words(rng, 60)
    long = words(rng, 4000)
    rows = [words(rng, rng.randrange(5, 200)) for _ in range(40)]
    rows += [rows[0]] * 6 + [rows[1] + " end", "x " + rows[1]]  # copies and near copies
    rows += [words(rng, 30) + "\n" + passage + "\n" + words(rng, 20) for _ in range(8)]  # a common passage
    rows += ["", None, "   \n\t ", "one", "same same " * 300, "é" * 900, "a" * 1500, long, long[:9000] + " tail", "line\nline\nline\nother words\n" * 8, " nbsp em\x1cfs"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


ROWS = texts()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(d, t, None if d % 7 == 0 else "en", None if d % 11 == 0 else f"s{d % 4}", None) for d, t in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated and null ids, and columns with names that operators use inside."""
    rng = random.Random(5)
    same = words(rng, 80)
    data = [(1, same), (1, same), (1, words(rng, 50)), (None, same), (None, None), (2, "short")]
    return spark.createDataFrame([(d, t, "en", "s", 0, 9, "b", 1.0) for d, t in data], SCHEMA + ", doc_key int, bucket string, places double").select("*", F.lit(1).alias("size"), F.lit("x").alias("found"))


def test_substrings(docs):
    out = substring_dedup.dedup_substrings(docs)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())
    assert got == substring_dedup.brute(ROWS)
    assert sum(r[2] for r in got) > 500


def test_suffixes(docs):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.dedup_suffixes(docs).collect())
    assert got == suffix_dedup.brute(ROWS)
    assert sum(r[2] for r in got) > 5000


def test_suffixes_of_a_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    rng = random.Random(2)
    rows = [(1, words(rng, 900)), (2, "q" * 5000), (3, "ab" * 700 + words(rng, 300))]
    rows.append((4, rows[0][1][1500:4000]))
    data = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_key", "text"])
    covered = defaultdict(set)
    for keys, places, *_, size in suffix_dedup._coarse(iter([batch]), 200):
        for k, p, s in zip(keys.tolist(), places.tolist(), size.tolist(), strict=True):
            assert not covered[k] & set(range(p, p + s))
            covered[k] |= set(range(p, p + s))
    assert {k: len(v) for k, v in covered.items()} == {d: len(t.encode()) - 199 for d, t in rows}
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_suffixes(data).collect())
    assert got == [(r[0], r[2]) for r in suffix_dedup.brute(rows)]


def joined(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(x) for x in parts], np.int64)
    return data, np.repeat(np.cumsum(size), size)


@pytest.mark.parametrize("every", [2, 7, 48])
def test_corpus_order_is_that_of_all_suffixes(monkeypatch, every):
    monkeypatch.setattr(suffix_dedup, "EVERY", every)
    rng = random.Random(every)
    for letters, top in ((b"ab", 60), (b"abcd", 200), (b"a", 90), (bytes(range(256)), 300)):
        for _ in range(12):
            parts = [bytes(rng.choice(letters) for _ in range(rng.randrange(top))) for _ in range(rng.randrange(1, 6))]
            parts += rng.sample(parts, rng.randrange(len(parts) + 1)) + [parts[0][3:] + parts[-1]]
            data, ends = joined(parts)
            blob = data.tobytes()
            want = sorted(range(len(data)), key=lambda i: (blob[i : ends[i]], i))
            assert suffix_dedup.corpus_order(data, ends).tolist() == want
            for span in (1, 5, 8, 13, 24):
                order, kind = suffix_dedup.repeated_places(data, ends, span)
                got, by = defaultdict(set), defaultdict(set)
                for i, k in zip(order.tolist(), kind.tolist(), strict=True):
                    got[k].add(i)
                for i in range(len(data)):
                    if i + span <= ends[i]:
                        by[blob[i : i + span]].add(i)
                assert sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))


def test_dictionary_and_parse_settle_edges(spark):
    """Texts that share a passage in contexts of their own, which equal phrases alone can't settle."""
    rng = random.Random(31)
    passage = words(rng, 80)
    rows = [(i, words(rng, 40) + passage[i : i + 300] + words(rng, 40)) for i in range(60)] + [(100 + i, "ab" * (150 + i)) for i in range(5)]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    assert got == [(r[0], r[2]) for r in suffix_dedup.brute(rows)] and sum(r[1] for r in got) > 15000


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_vocabulary())
    whole.encode_special_tokens = True
    enc = tokens.encoder(tokens.default_vocabulary())
    rng = random.Random(1)
    parts = ["a", "B", "é", "中", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "'s", "12", ".", "!?", "🙂", "<|endoftext|>", " '", "​"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert enc(pa.array([x]))[0].tolist() == whole.encode(x, add_special_tokens=False).ids, repr(x)


def test_encoder_with_added_tokens():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_vocabulary())
    enc = tokens.encoder(tokens.default_vocabulary(), special=True)
    assert enc(pa.array(["hello <|endoftext|> world"]))[0].tolist() == [31373, 220, 50256, 995]
    rng = random.Random(3)
    parts = ["a", "B", "é", "中", " ", "  ", "\n", "'s", "12", ".", "<|endoftext|>", "<|endof", "text|>", "<|", "|>", "　"]
    for _ in range(500):  # many texts at once: no token across two of them
        some = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(8)]
        assert [x.tolist() for x in enc(pa.array(some))] == [x.ids for x in whole.encode_batch(some, add_special_tokens=False)], some


def test_encoder_with_added_tokens_that_look_around(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    whole = Tokenizer.from_file(tokens.default_vocabulary())
    whole.add_special_tokens([AddedToken("<w>", lstrip=True, rstrip=True), AddedToken("<w><v>", single_word=True)])
    whole.save(str(tmp_path / "more.json"))
    enc = tokens.encoder(str(tmp_path / "more.json"), special=True)
    rng = random.Random(4)
    for _ in range(500):
        some = ["".join(rng.choice(["a", " ", "  ", ".", "<w>", "<v>", "<w><v>", "<|endoftext|>"]) for _ in range(rng.randrange(9))) for _ in range(4)]
        assert [x.tolist() for x in enc(pa.array(some))] == [x.ids for x in whole.encode_batch(some, add_special_tokens=False)], some


def test_store_and_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_vocabulary())
    rows = [(1, "hello <|endoftext|> world"), (2, "x" + "<|endoftext|>" * 1500), (3, "after")]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    folder = common.new_folder(spark, "added")
    token_store.write_store(data, folder)
    got = {r.doc_key: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, folder).collect()}
    pieces = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.pack(data).collect()}
    at, crc = 0, lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for d, t in rows:
        ids = whole.encode(t, add_special_tokens=False).ids
        assert got[d] == (at, len(ids) + 1, crc([*ids, 0]))
        at += len(ids) + 1
        first = (len(ids) + 1) % 1024 or 1024
        assert pieces[d, 0] == (first, crc([*ids, 2][:first]))


def test_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CUTS", 3)
    enc = tokens.Encoder(tokens.default_vocabulary())
    rng = random.Random(2)
    for _ in range(40):
        texts = [words(rng, rng.randrange(6)) for _ in range(4)]
        want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc(pa.array(texts))] == want
    assert [len(x) for x in enc(pa.array(["", None]))] == [0, 0]
    assert enc(pa.array([], pa.string())) == []


def ids_of(text, end):
    return [*tokens.encoder(tokens.default_vocabulary(), special=True)(pa.array([text or ""]))[0].tolist(), end]


def test_store_round_trip(spark, docs):
    folder = common.new_folder(spark, "test")
    assert token_store.write_store(docs, folder, shard_ids=5000) is None
    got = {r.doc_key: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, folder).collect()}
    at, want = 0, {}
    for d, t in ROWS:
        ids = ids_of(t, 0)
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    keys = spark.createDataFrame([(4,), (7,), (5,)], "doc_key long")
    assert {r.doc_key: r.ids for r in token_store.lookup(spark, folder, keys).collect()} == {4: ids_of(ROWS[1][1], 0), 7: ids_of(ROWS[2][1], 0)}
    every = spark.createDataFrame([(d + k,) for d, _ in ROWS for k in (0, 0, 1)] + [(-5,), (10**12,), (None,)], "doc_key long")
    assert {r.doc_key: r.ids for r in token_store.lookup(spark, folder, every).collect()} == {d: ids_of(t, 0) for d, t in ROWS}
    for d, t in ROWS[::7]:
        assert token_store.fetch(spark, folder, d).tolist() == ids_of(t, 0) and token_store.fetch(spark, folder, d + 1) is None


def whole_ids(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.default_vocabulary()).encode(text or "", add_special_tokens=False).ids, end]


def test_own_encoder_against_an_untouched_library():
    assert all(ids_of(t, 0) == whole_ids(t, 0) for _, t in ROWS)


def test_index_is_minimal_and_perfect():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    index = token_store.Index(token_store.build_index(keys, np.arange(len(keys), dtype=np.uint64)))
    found, (values,) = index(keys)
    assert found.all() and (values == np.arange(len(keys))).all()
    assert not index(keys + 1)[0].any()
    assert not token_store.Index(token_store.build_index(keys[:0]))(keys)[0].any()


def test_quality(docs):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(ROWS)
    for d, t in ROWS:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_rules.brute(t), d
        text, m = t or "", {k: r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        assert r.kept == (not r.base_failed and not any(rule(quality_rules.Page(text, m)) for rule in quality_rules.RULES.values()))


def plain_verdict(text):
    """The rules in plain Python, each from the text alone."""
    import re

    words_ = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words_), sum(map(len, words_))
    lines = text.split("\n")
    dup = sum(x in lines[:i] and bool(x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(lines))
    letters = sum(x.isalpha() for x in text)
    return not (
        10 * len(re.findall(r"[#*$%&|<>]", text)) > 3 * n or chars < 2 * n or chars > 20 * n or (dup >= 3 and 10 * dup > 3 * len(lines)) or 10 * len(re.findall(r"!!+|\?\?+", text)) > 2 * n
        or sum(x.isupper() for x in text) > sum(x.islower() for x in text) or 2 * letters < chars or (n and 10 * max(words_.count(w) for w in set(words_)) > 4 * n) or 10 * sum(a == b for a, b in zip(words_, words_[1:], strict=False)) > 3 * n
    )


def test_verdicts_by_hand(spark):
    rng = random.Random(21)
    odd = ["#", "$$", "LOUD", "what??", "no!!", "1234", "a", "x" * 30, "word", "word", "Plain", "été"]
    rows = []
    for i in range(300):
        own = rng.sample(odd, rng.randrange(1, 7))
        rows.append((i, " ".join(rng.choice(own if rng.random() < 0.6 else [f"w{rng.randrange(400)}ord"]) + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.randrange(20, 60)))))
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = [d for d, t in rows if not got[d].base_failed and plain_verdict(t)]
    assert [d for d, _ in rows if got[d].kept] == kept and 0 < len(kept) < sum(not r.base_failed for r in got.values())


def test_rule_order_follows_the_sample():
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(60))
    texts = [" ".join(x + "###" for x in prose().split()) for _ in range(60)] + [prose() for _ in range(20)]
    order = quality_rules.estimate(texts)
    assert sorted(x[0] for x in order) == sorted(quality_rules.RULES) and order[0][0] == "symbols" and order[0][2] == 0.75
    assert all(x[2] == 0 for x in order[1:])  # of what symbols leaves, nothing is rejected


def test_samples_are_bounded_in_bytes(spark, docs):
    sizes = sorted(len((t or "").encode()) for _, t in ROWS)
    assert len(common.sampled_texts(docs, 10, 1 << 30)) == 10
    some = common.sampled_texts(docs, 1000, 20_000)
    assert sum(len(x.encode()) for x in some) <= 20_000 and some == common.sampled_texts(docs.repartition(3), 1000, 20_000)
    assert len(common.sampled_texts(docs, 1000, 0)) == 1 and len(common.sampled_texts(docs, 1000, sum(sizes))) == len(ROWS)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(2)).collect()}
    assert {r.doc_id: r.taken for r in rows} == again
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and r.size == len((dict(ROWS)[r.doc_id] or "").encode().split())
    sizes = {s: sum(r.size for r in g) for s, g in by.items()}
    order = [*sorted(s for s in by if s is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, target, rest = set(order), {}, float(sum(sizes.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            open_.discard(s)
    for s, g in by.items():
        assert g[0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in g) - target[s]) <= 1
    taken = {r.doc_id: r.taken for r in rows}
    seen = defaultdict(int)
    for r in mixing.mixed_texts(docs).collect():
        seen[r.doc_id] += len(r.text.encode().split())
    assert dict(seen) == {d: n for d, n in taken.items() if n}


def test_mixed_texts_of_many_null_ids(spark):
    rng = random.Random(12)
    data = [(None if i % 3 else 7, f"t{i} " + words(rng, rng.randrange(1, 30)), rng.choice(["en", "de"]), f"s{i % 5}", i) for i in range(6000)]
    names = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame(data, SCHEMA).repartition(6)
        keys = {r.text: r.doc_key for r in mixing.c.documents(docs, "source").collect()}
        assert sorted(keys.values()) == list(range(6000))
        assert keys == {r.text: r.doc_key for r in mixing.c.documents(docs.repartition(2), "lang", "n_chars").collect()}
        got = mixing.mixed_texts(docs).collect()
        want = defaultdict(float)
        for r in mixing.mix(docs).select("source", "target").distinct().collect():
            want[r.source] = r.target
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole, taken = {t.split()[0]: (t, s) for _, t, _, s, _ in data}, defaultdict(int)
    for r in got:
        text, source = whole[r.text.split()[0]]
        assert r.source == source and text.startswith(r.text)
        taken[source] += len(r.text.split())
    assert taken.keys() == want.keys() and all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_language_model(docs):
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score(docs).collect())
    want = language_model.brute_base(ROWS)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in got) > sum(g[5] for g in got) and all(g[6] < 0 for g in got) and held
    again = sorted((r.doc_id, r.score) for r in language_model.score(docs).collect())
    assert [a[1] for a in again] == pytest.approx([g[6] for g in got])


def brute_model(rows, warm=language_model.WARM, burn=language_model.BURN_IN, samples=language_model.SAMPLES):
    """Scores by dictionaries, a customer at a time, with the model's random numbers."""
    m, mix = language_model, lambda x: int(common.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    known = {}

    def named(w):
        if w not in known:
            data = np.frombuffer(w, np.uint8)
            known[w] = int(common.word_hashes(data, np.array([0]), np.array([len(w)]))[0])
        return known[w]

    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    texts, held = {}, {}
    for d, t in rows:
        ws = [*map(named, (t or "").encode().translate(lower).split()), int(m.END)]
        mark = int(m.start_mark(np.array([d]))[0])
        before = [mark, int(m.START), *ws]
        texts[d], held[d] = [(before[i], before[i + 1], w) for i, w in enumerate(ws)], zlib.crc32(str(d).encode()) % 10 == 0
    seen, count = defaultdict(int), defaultdict(int)
    for d, ts in texts.items():
        for u, v, w in ts:
            seen[u, v, w] += not held[d]
            count[w] += not held[d]
    tokens_, vocabulary = sum(count.values()), sum(n > 0 for n in count.values())
    a, b, e, _ = (int(x) for x in m._TIMES)

    def seats(customers, mass, discount, dish, sweep):
        tables = min(customers, 1)
        seated = 1
        while seated < customers:
            step = 1 if seated < 64 else seated // 16
            new = mass / (seated - discount * tables + mass)
            r = float(m.uniform(np.array([dish], np.uint64), sweep, seated)[0])
            tables += int(min(step, customers - seated) * new + r)
            seated += step
        return tables

    def start():
        t3 = {k: min(n, 1) for k, n in seen.items()}
        c2 = defaultdict(int)
        for (u, v, w), n in t3.items():
            c2[v, w] += n
        return t3, c2, {k: min(n, 1) for k, n in c2.items()}

    c3 = defaultdict(int)
    for (u, v, w), n in seen.items():
        c3[u, v] += n

    def totals(t3, c2, t2):
        x3, x2, y2 = defaultdict(int), defaultdict(int), defaultdict(int)
        for (u, v, w), n in t3.items():
            x3[u, v] += n
        for (v, w), n in c2.items():
            x2[v] += n
        for (v, w), n in t2.items():
            y2[v] += n
        return x3, x2, y2

    def middle(c2, t2, x2, y2, v, w, root):
        return (c2[v, w] - m.DISCOUNT[1] * t2[v, w] + (m.STRENGTH[1] + m.DISCOUNT[1] * y2[v]) * root[w]) / (m.STRENGTH[1] + x2[v])

    def sweep(state, root, number):
        t3, c2, t2 = state
        x3, x2, y2 = totals(*state)
        t3 = {(u, v, w): seats(n, (m.STRENGTH[2] + m.DISCOUNT[2] * x3[u, v]) * middle(c2, t2, x2, y2, v, w, root), m.DISCOUNT[2], mix(u * a + v * b + w * e), number) for (u, v, w), n in seen.items()}
        c2 = defaultdict(int)
        for (u, v, w), n in t3.items():
            c2[v, w] += n
        return t3, c2, {(v, w): seats(n, (m.STRENGTH[1] + m.DISCOUNT[1] * y2[v]) * root[w], m.DISCOUNT[1], mix(v * b + w * e), number) for (v, w), n in c2.items()}

    def rooted(t2, mass):
        c1 = defaultdict(int)
        for (v, w), n in t2.items():
            c1[w] += n
        t1 = {w: seats(n, mass, m.DISCOUNT[0], w, 0) for w, n in c1.items()}
        base = (m.STRENGTH[0] + m.DISCOUNT[0] * sum(t1.values())) / (vocabulary + 1)
        return {w: (c1[w] - m.DISCOUNT[0] * t1[w] + base) / (m.STRENGTH[0] + sum(c1.values())) for w in c1}

    state = start()
    for s in range(warm):
        state = sweep(state, defaultdict(lambda: m.ROOT), s + 1)
    root = rooted(state[2], m.DISCOUNT[0])
    state, mean = start(), defaultdict(float)
    for s in range(burn + samples):
        state = sweep(state, root, warm + s + 1)
        if s >= burn:
            x3, x2, y2 = totals(*state)
            for (u, v, w), n in seen.items():
                p = (n - m.DISCOUNT[2] * state[0][u, v, w] + (m.STRENGTH[2] + m.DISCOUNT[2] * x3[u, v]) * middle(state[1], state[2], x2, y2, v, w, root)) / (m.STRENGTH[2] + c3[u, v])
                mean[u, v, w] += p / samples
    return {d: sum(np.log10(mean[x]) for x in ts) for d, ts in texts.items()}


def test_language_model_is_the_brute_model(docs):
    got = {r.doc_id: r.score for r in language_model.score(docs).collect()}
    want = brute_model(ROWS)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-5) for d in want)


def test_language_model_does_not_depend_on_partitions(spark, docs, monkeypatch):
    got = {r.doc_id: r.score for r in language_model.score(docs).collect()}
    monkeypatch.setattr(language_model, "FLUSH", 700)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 10_000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = {r.doc_id: r.score for r in language_model.score(docs.repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.keys() == again.keys() and all(again[d] == pytest.approx(got[d], abs=1e-5) for d in got)


def test_language_model_of_frequent_words(docs, monkeypatch):
    """Restaurants of frequent words are split; probabilities of all words still add up to 1."""
    monkeypatch.setattr(language_model, "PART", 200)
    monkeypatch.setattr(language_model, "SAMPLED", 1)
    rows = common.documents(docs)
    words_, parts = language_model._frequent(rows)
    assert len(words_) and (parts > 1).all()
    got = language_model.score(docs).collect()
    want = {w[0]: w for w in language_model.brute_base(ROWS)}
    assert all((r.n_tokens, r.n_known) == want[r.doc_id][2:4] and r.score < 0 for r in got)


@pytest.mark.parametrize("tasks", [1 << 15, 3])
def test_language_model_has_one_restaurant_for_a_frequent_word(docs, monkeypatch, tasks):
    """Whether a word's tokens go to one bucket or to several, scores are those of the model that splits nothing."""
    for name, value in (("PART", 20), ("SAMPLED", 1), ("BUCKET_BYTES", 10_000), ("FLUSH", 2000)):
        monkeypatch.setattr(language_model, name, value)
    monkeypatch.setattr(common, "MOST_TASKS", tasks)
    words_, parts = language_model._frequent(common.documents(docs))
    assert len(words_) > 3 and parts.max() > 5
    got = {r.doc_id: r.score for r in language_model.score(docs).collect()}
    want = brute_model(ROWS)
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-5) for d in want)


def test_probabilities_add_up_to_1():
    rng = np.random.default_rng(2)
    words_ = np.unique(rng.integers(1, 2**63, 40).astype(np.uint64))
    far, near = np.repeat(words_[:3], len(words_)), np.repeat(words_[3], 3 * len(words_))
    far, near, word = (np.repeat(x, 3) for x in (far, near, np.tile(words_, 3)))
    held = rng.random(len(far)) < 0.5
    row = {"bucket": 0, "more": [common.small(x) for x in (np.searchsorted(words_, far), np.searchsorted(words_, word), np.r_[words_[:1], np.diff(words_)])]}
    row["keys"], row["runs"], row["places"] = common._rises(np.zeros(len(far), np.int64), 2 * np.searchsorted(words_, near) + held)
    b = language_model._Bucket([row])
    root = rng.dirichlet(np.ones(len(b.words)))
    for s in range(5):
        b.sweep(root, s)
        assert np.bincount(b.context, b.probability(root)) == pytest.approx(1)


def test_seating_has_the_right_mean():
    n, dish = np.full(4000, 12), np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    got = language_model.seat(n, np.full(4000, 2.0), 0.5, dish, 1).mean()
    expect = np.zeros(13)
    expect[1] = 1
    for seated in range(1, 12):  # exact distribution of the number of tables
        new = np.zeros(13)
        for k in range(1, seated + 1):
            p = 2.0 / (seated - 0.5 * k + 2.0)
            new[k + 1] += expect[k] * p
            new[k] += expect[k] * (1 - p)
        expect = new
    assert got == pytest.approx((expect * np.arange(13)).sum(), abs=0.15)


def test_simhash(docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.simhash_groups(docs).collect())
    assert got == simhash_dedup.brute(ROWS)


def test_trie_finds_all_pairs():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    keys = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(12)} | {0, 1, 2**64 - 1}
    keys = np.array(sorted(keys), np.uint64)
    got = set()
    for most in (1 << 21, 64):
        for i, j in simhash_dedup.trie_links(keys, 3, most):
            got |= set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if (int(keys[i]) ^ int(keys[j])).bit_count() <= 3}
    assert got == want and want


def test_near_groups_of_planted_fingerprints(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(8)]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    got = {r.doc_key: r.component for r in simhash_dedup.near_groups(spark.createDataFrame(rows, "doc_key long, fingerprint long")).collect()}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(prints))}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (60, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 45: 40, 50: 40}


def test_toxicity(spark):
    rng = random.Random(6)
    plain = [f"w{i}ord" for i in range(200)]
    bad = ["horrible", "dreadful", "nasty"]
    rows, labels = [], []
    for i in range(400):
        own = [rng.choice(plain) for _ in range(40)]
        if i % 3 == 0:
            own[5:8] = bad
        rows.append((i, " ".join(own)))
        labels.append((i, None if i % 50 == 49 else int(i % 3 == 0)))
    rows += [(1000, "w1ord w2ord w3ord horible dreadfull nassty"), (1001, ""), (1002, None)]
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    right = [out[i].predicted == int(i % 3 == 0) for i in range(400) if out[i].held_out]
    assert np.mean(right) > 0.95 and out[1000].score > out[1].score


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    edited = fingerprints.brute_edits(ROWS)
    assert [(d, got[d].n_chars, got[d].edited_sha256) for d, *_ in edited] == [e[:3] for e in edited]
    prints = {d: int(got[d].fingerprint, 16) for d in got}
    ids = sorted(got)
    for i, d in enumerate(ids):
        after = prints[ids[(i + 1) % len(ids)]]
        assert got[d].near_next == 1 - (prints[d] ^ after).bit_count() / 64
        assert got[d].near_edited == 1 - (prints[d] ^ int(got[d].edited_fingerprint, 16)).bit_count() / 64
    own = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert all(own[d] & (2**64 - 1) == prints[d] for d in ids)


def test_block_tables_find_all(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(25)]
    prints = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(6)}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    got = sorted((r.query, r.fingerprint) for r in fingerprints.within(df, df).collect())
    assert got == sorted((signed(a), signed(b)) for a in prints for b in prints if (a ^ b).bit_count() <= 3)


def test_packing(docs):
    check_packing(packing.pack(docs).collect(), ROWS)


def check_packing(got, rows):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for d, t in rows:
        ids, at = ids_of(t, 2), 0
        total += len(ids)
        for k, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids) and len(by[d]) == -(-len(ids) // 1024)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(sequences) <= 1.1 * total / 1024 + 2


def test_plan_uses_every_piece():
    rng = np.random.default_rng(3)
    have = np.bincount(rng.integers(1, 1025, 5000), minlength=1025)
    planned = packing.plan(have)
    used = np.zeros_like(have)
    for pattern, times in planned:
        assert sum(pattern) <= 1024 and times > 0
        for x in pattern:
            used[x] += times
    assert (used == have).all()
    total = (have * np.arange(1025)).sum()
    assert sum(t for _, t in planned) <= 1.02 * total / 1024 + 1
    assert packing.plan(np.zeros(1025, int)) == []


def best_fit_decreasing(have, size=1024):
    """Sequences that best fit needs, a piece at a time."""
    rooms, n = [], 0
    for x in range(size, 0, -1):
        for _ in range(int(have[x])):
            at = bisect.bisect_left(rooms, x)
            room = size if at == len(rooms) else rooms.pop(at)
            n += room == size
            bisect.insort(rooms, room - x)
    return n


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_fitted_patterns_need_no_more_than_best_fit(sf):
    import pyarrow.parquet as pq

    sizes = np.array([len(x) + 1 for x in tokens.encoder(tokens.default_vocabulary(), special=True)(pq.read_table(f"/root/testdata/sf{sf}/documents.parquet", columns=["text"])["text"].combine_chunks())])
    first = np.where(sizes % 1024 == 0, 1024, sizes % 1024)
    have = np.bincount(first, minlength=1025)
    have[1024] += ((sizes - first) // 1024).sum()
    planned = packing.plan(have)
    assert -(-sizes.sum() // 1024) <= sum(t for _, t in planned) <= best_fit_decreasing(have)
    assert sum(t for p, t in planned if sum(p) == 1024) > 0.6 * sum(t for _, t in planned)


OPERATORS = {
    "op1": lambda d: substring_dedup.dedup_substrings(d), "op3": lambda d: suffix_dedup.dedup_suffixes(d), "op4": lambda d: quality_rules.judge(d), "op5": lambda d: mixing.mix(d), "op6": lambda d: language_model.score(d),
    "op7": lambda d: simhash_dedup.simhash_groups(d), "op8": lambda d: toxicity.score(d, d.select("doc_id", F.lit(1).alias("toxic"))), "op9": lambda d: fingerprints.compare(d), "op10": lambda d: packing.pack(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def test_empty_store(spark, empty):
    folder = common.new_folder(spark, "empty")
    token_store.write_store(empty, folder)
    assert token_store.read_store(spark, folder).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None", "None"]


def test_odd_store(spark, odd):
    folder = common.new_folder(spark, "odd")
    names = token_store.write_store(odd, folder)
    got = token_store.c.named(token_store.read_store(spark, folder), names).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None", "None"]


def clashing(docs):
    """All the names that operators and stages use inside, with values of their own."""
    names = "doc_key places more bucket keys runs size taken key_taken part found whole_row clean fingerprint component node slice inside grp h rank word target source_size kept".split()
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names]), names


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_clashing_names_and_odd_rows(spark, docs, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    wide, names = clashing(docs)
    got = stage(spark, wide, "")
    plain = stage(spark, docs, "")
    if name != "sequence_packing":
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in wide.schema]
        for r in got.collect():
            assert all(r[n] == f"{n}:{r.doc_id}" for n in names)
        assert stage(spark, empty, "").columns == empty.columns
        ids = {str(r.doc_id) for r in stage(spark, odd, "").collect()}
        assert ids <= {"1", "2", "None"}
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert stage(spark, empty, "").count() == 0


def test_very_long_texts(spark):
    """Two texts beyond a piece, one of them mostly a copy of the other."""
    rng = random.Random(40)
    base = " ".join(f"w{rng.randrange(10**7)}" for _ in range(600_000))
    rows = [(1, base), (2, "before " + base[:4_000_000] + " after"), (3, "short")]
    assert len(base) > common.PIECE_BYTES
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    own = {d: len(t.split()) for d, t in rows}
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()}
    same = len(base[:4_000_000].rsplit(" ", 1)[0].split())
    assert got[1] == (own[1], 0) and got[2][0] == own[2] and got[2][1] in (same, same + 1) and got[3] == (1, 0)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.dedup_suffixes(docs).collect()}
    assert got[1] == (len(base), 4_000_000, 1) and got[2][1:] == (4_000_000, 1) and got[3] == (5, 0, 0)
    judged = {r.doc_id: r.n_words for r in quality_rules.judge(docs).collect()}
    assert judged == own and {r.doc_id: r.size for r in mixing.mix(docs).collect()} == own
    assert {r.doc_id: r.n_tokens for r in language_model.score(docs).collect()} == {d: n + 1 for d, n in own.items()}
    pieces = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    folder = common.new_folder(spark, "long")
    token_store.write_store(docs, folder)
    assert {r.doc_key: r.n_tokens for r in token_store.read_store(spark, folder).collect()} == {r.doc_id: r.n for r in pieces}
    assert len(fingerprints.compare(docs).collect()) == len(simhash_dedup.simhash_groups(docs).collect()) == 3


def test_facts_in_more_buckets_than_tasks(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "MOST_TASKS", 3)
    monkeypatch.setattr(common, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(common, "FLUSH", 3000)
    test_substrings(docs)
    test_suffixes(docs)
    got = {r.doc_id: r.score for r in language_model.score(docs).collect()}
    want = brute_model(ROWS)
    assert all(got[d] == pytest.approx(want[d], abs=1e-5) for d in want)


def test_a_line_in_every_document(spark):
    """What all documents share meets in no bucket more than a few times for each flush."""
    rng = random.Random(77)
    line = words(rng, 60)
    rows = [(i, words(rng, 12) + " " + line + " " + words(rng, 12)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    slots = common.even_keys(8)
    facts = docs.withColumn("doc_key", F.col("doc_id")).mapInArrow(substring_dedup._probes(13, 8, slots), common.FACTS)
    asked = [common.receive(iter([pa.RecordBatch.from_pylist([r.asDict()], schema=common._FACTS)]), 1, 0)[0][0] for r in facts.collect()]
    assert sum(map(len, asked)) < 3000 * 24 + 6 * 3 * 80
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect())
    assert got == [r[:3] for r in substring_dedup.brute(rows)]
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_suffixes(docs).collect()) == [(r[0], r[2]) for r in suffix_dedup.brute(rows)]


def test_fingerprints_with_an_outlying_id(spark):
    rng = random.Random(78)
    rows = [(i, words(rng, 5)) for i in range(9000)] + [(2**60, "far away from all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = docs.select(F.col("doc_id").alias("doc_key"))
    sizes = [r["count"] for r in keys.select(fingerprints._groups(keys).alias("grp")).groupBy("grp").count().collect()]
    assert max(sizes) < 5000 and len(sizes) > 60
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in fingerprints.compare(docs).collect()}
    assert all(got[d] == (n, h) for d, n, h, _ in fingerprints.brute_edits(rows))


def brute_print(text):
    """A fingerprint from Spark's hash of each pair of words, votes counted in Python."""
    import re

    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_fingerprints_against_votes_in_python(spark, docs):
    pairs = {d: list(zip(w, w[1:] + [None], strict=True)) for d, t in ROWS for w in [brute_print(t)] if 0 < len(w) < 300}
    flat = sorted({p for ps in pairs.values() for p in ps}, key=str)
    table = spark.createDataFrame(flat, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h"))
    h = {(r.a, r.b): r.h & (2**64 - 1) for r in table.collect()}
    got = {r.doc_id: int(r.fingerprint, 16) for r in fingerprints.compare(docs).collect()}
    for d, ps in pairs.items():
        want = sum(1 << j for j in range(64) if 2 * sum(h[p] >> j & 1 for p in ps) > len(ps))
        assert got[d] == want, d


def test_n_near_against_all_pairs(docs):
    got = fingerprints.compare(docs).collect()
    prints = {int(r.fingerprint, 16) for r in got}
    for r in got:
        own = int(r.fingerprint, 16)
        want = sum(0 < (own ^ p).bit_count() <= 3 for p in prints) if r.doc_id % 20 == 0 else None
        assert r.n_near == want


def test_toxicity_scores_are_those_of_the_model(spark):
    """A row's score is the softmax of its words' vectors, from the same trained table, one text at a time."""
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["good", "fine", "bad", "awful", "Zebra", "naïve"]) for _ in range(rng.randrange(12)))) for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(d, int("awful" in t)) for d, t in rows], "doc_id long, toxic int")
    values, bias = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for d, t in rows:
        means = [np.mean([float(np.float32(values[i])) for i in toxicity.subwords(w)]) for w in toxicity.words(t)]
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(bias + (np.mean(means) if means else 0)))), rel=1e-4)


def test_repeated_rows_lose_to_the_first(odd):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(odd).collect())
    assert got == [("1", 50, 0), ("1", 80, 0), ("1", 80, 80), ("2", 1, 0), ("None", 0, 0), ("None", 80, 80)]


def test_pipeline(spark, docs, tmp_path):
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/quality").collect()}
    assert good == {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/near_dedup").collect()}
    source = {d: t for d, t in ROWS if d in good}
    assert sorted(kept) == sorted({c for _, _, c in simhash_dedup.brute(list(source.items()))})
    clean = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/repeat_removal").collect()}
    assert {d: len(t.encode()) for d, t in kept.items()}.keys() == clean.keys()
    for d, n, removed, _, digest in suffix_dedup.brute(list(kept.items())):
        if removed == 0:
            assert clean[d] == kept[d]
    rows = [(r.doc_id, r.text) for r in now.collect()]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(d for d, _ in rows)
