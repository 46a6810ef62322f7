"""Each operator on hand-made rows (nulls, empty and repeated rows, ties, clashing columns) against brute force, and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passage_engine.llm import agenda_bpe, embedding_dedup, fingerprints, line_dedup, minhash, mixing, quality, simple8b, suffix_dedup, token_counts, token_files
from passage_engine.llm.components import components
from passage_engine.llm.queries import op5_suffix_dedup, vocabulary

WORDS = "the of and harbor tide moon café naïve straße lamp keeper dusk storm rope anchor sail deck crew port star".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) * (r.random() < 0.7) for _ in range(n))


LONG = prose(1, 300)
TEXTS = [
    (1, LONG), (2, LONG), (2, LONG), (3, LONG.replace("tide", "wave", 1)), (4, None), (5, ""), (6, "one two"), (6, "three"), (7, "one two"),
    (8, prose(2, 150) + " " + prose(3, 120) + " " + prose(4, 60)), (9, prose(5, 100) + "\n" + prose(3, 120)), (10, "  a  b\t\n c <|endoftext|> ▁ 😀 d "),
    (11, prose(6, 90) * 2), (None, "no id at all"), (12, prose(7, 4000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{(i or 0) % 3}" if i != 7 else None, "x", 1, 2) for i, t in TEXTS]
    # Columns whose names the operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, source string, h1 string, size int, label int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by_text(rows):
    """Rows in a fixed order with nulls last."""
    return sorted((tuple(r) for r in rows), key=repr)


def shingles(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_simple8b_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1023, 1024, 1025, 9000):
        for high in (1, 2, 1000, 2**32, 2**64):
            v = (rng.random(n) ** 3 * (high - 1)).astype(np.uint64)
            words, offsets, escapes = simple8b.encode(v)
            assert (simple8b.decode(words, offsets, escapes, n) == v).all()
            assert len(escapes) == (v >= 1 << 60).sum()
    assert len(simple8b.encode(np.zeros(1024, np.uint64))[0]) == 9


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    some = docs.where("doc_id is not null")
    token_files.write(some, f"{tmp_path}/ids", path, end_id=2)
    got = token_files.read(spark, f"{tmp_path}/ids").orderBy("start").collect()
    ids = {t or "": [*tk.encode(t or "", add_special_tokens=False).ids, 2] for _, t in TEXTS}
    want = Counter((d, tuple(ids[t or ""])) for d, t in TEXTS if d is not None)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    token_files.write(none, f"{tmp_path}/no", path, end_id=2)
    assert token_files.read(spark, f"{tmp_path}/no").count() == 0


def test_sentencepiece(docs, none):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def row(d, t):
        ids = sp.encode(t or "")
        return d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode() if ids else b"").hexdigest()

    assert by_text(agenda_bpe.encode_decode(docs, path).collect()) == by_text(row(d, t) for d, t in TEXTS)
    assert agenda_bpe.encode_decode(none, path).count() == 0
    alphabet = ["a", " ", "  ", "\n", "é", "日", "▁", "1", "'s", "\x00", "😀", ".", "\t"]
    r = random.Random(4)
    odd = ["".join(r.choice(alphabet) for _ in range(r.randrange(12))) for _ in range(3000)]
    for t, units in zip(odd, agenda_bpe.encode_texts(odd, path), strict=True):
        assert [i for u in units for i in u[0]] == sp.encode(t)


def test_agendas_of_many_units_are_those_of_each(monkeypatch):
    m = agenda_bpe.AgendaModel(vocabulary("piece_bpe_32k.model"))
    r = random.Random(12)
    parts = [*"aeinrst", "th", "er", "ß", "é", "日", "😀", "\n", "\x00", "1", "$$", ".", "▁", "ing"]
    units = [agenda_bpe.SPACE + "".join(r.choice(parts) for _ in range(r.randrange(24))) for _ in range(3000)] + ["\n", "\ntide", agenda_bpe.SPACE]
    monkeypatch.setattr(agenda_bpe, "TOGETHER", 700)
    assert m.encode_together(units) == [m.encode_unit(u) for u in units] and m.encode_together([]) == []
    # Equal scores are joined from the left, and characters that are no piece stay characters.
    m.cost = {p: float(x // 4000) for p, x in m.cost.items()}
    del m.ids["e"]
    m._number()
    assert m.encode_together(units) == [m.encode_unit(u) for u in units]


def test_units_of_a_full_table_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(agenda_bpe, "TABLE_UNITS", 3)
    m = agenda_bpe.AgendaModel(vocabulary("piece_bpe_32k.model"))
    monkeypatch.setitem(agenda_bpe._models, "here", m)
    met, together = [], m.encode_together
    monkeypatch.setattr(m, "encode_together", lambda units: met.append(sorted(units)) or together(units))
    for text in ("a b c d", "a e", "x y z", "a b", "w"):
        assert [i for u in agenda_bpe.encode_texts([text], "here")[0] for i in u[0]] == m.library.encode(text)
    assert met == [["▁a", "▁b", "▁c", "▁d"], ["▁e"], ["▁x", "▁y", "▁z"], ["▁b"], ["▁w"]] and len(m.table) <= 4
    # A unit that differs from the library stops the job and leaves nothing behind.
    monkeypatch.setattr(m, "encode_together", lambda units: [(1,) for _ in units])
    with pytest.raises(ValueError, match="differ"):
        agenda_bpe.encode_texts(["tide"], "here")
    assert not m.table and not m.table.fresh and not m.table.old


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(docs, none, name, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 700)
    path = vocabulary(name)
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t, sp=sentencepiece.SentencePieceProcessor(model_file=path): len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, tk=Tokenizer.from_file(path): len(tk.encode(t, add_special_tokens=False).ids)
    want = [(d, len((t or "").encode()), n := count(t or ""), n > 512) for d, t in TEXTS]
    assert by_text(token_counts.token_counts(docs, path).collect()) == by_text(want)
    assert token_counts.token_counts(none, path).count() == 0


def test_pre_tokens_are_counted_once_and_add_up(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 40)
    path = vocabulary("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    r = random.Random(8)
    parts = ["the", "tide", "don't", " ", "  ", "\n", "é", "<|endoftext|>", "12", "日本", "...", "a" * 60]
    rows = [(k % 50, " ".join(r.choice(parts) for _ in range(r.randrange(9)))) for k in range(400)] + [(None, " "), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((x["doc_id"], x["n_tokens"]) for x in token_counts.token_counts(df, path).collect())
    assert got == Counter((d, len(tk.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    # Each distinct pre-token is counted in one bucket, once.
    counted = token_counts.pieces(token_counts.frequencies(df), path, 5).groupBy("bucket").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert counted == len({p for _, t in rows for p in token_counts.pre_tokens(t or "")})


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    assert by_text(rows) == by_text(mixing.mix(docs.repartition(5)).collect())
    taken, goal, size = Counter(), {}, Counter()
    for r in rows:
        taken[r["source_size"]] += r["taken"]
        size[r["source_size"]] += r["size"]
        goal[r["source_size"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(taken[k] == int(goal[k]) <= 2 * k for k in goal)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(size.values()))
    kept = mixing.take(docs)
    assert kept.columns == docs.columns and kept.count() >= 1
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0


def test_hot_source_is_cut_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    many = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    got = mixing.mix(many).groupBy("source_size", "target").agg(F.sum("taken").alias("n")).collect()
    assert all(r["n"] % int(r["target"]) == 0 for r in got)  # some sources have one size and one target


def test_suffix_dedup(spark, docs, none, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    texts = [(t or "").encode() for _, t in TEXTS]

    def brute(match):
        seen = Counter(t[k : k + match] for t in texts for k in range(len(t) - match + 1))
        for (d, _), t in zip(TEXTS, texts, strict=True):
            gone = np.zeros(len(t) + 1, bool)
            for k in range(len(t) - match + 1):
                if seen[t[k : k + match]] > 1:
                    gone[k : k + match] = True
            kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
            yield d, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()

    assert by_text(suffix_dedup.repeats(docs).collect()) == by_text(brute(400))
    assert by_text(suffix_dedup.repeats(docs, match=60).collect()) == by_text(brute(60))
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(TEXTS)
    assert suffix_dedup.repeats(none).count() == 0


def test_suffix_passages_below_the_match_stay(spark, tmp_path):
    """A shared passage of over 50 words goes from 400 bytes on, as the query's contract fixes it; a shorter match takes it too."""
    r = random.Random(10)
    short, long, clean = ("".join(r.choices("abcdefgh", k=5)) + "".join(" " + "".join(r.choices("abcdefgh", k=5)) for _ in range(66)) for _ in range(3))
    short, long = short[:399], long[:400]
    assert min(len(short.split()), len(long.split())) > 50
    texts = [f"1{short}2", f"3{short}4", f"5{long}6", f"7{long}8", clean]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["n_removed"] for r in op5_suffix_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()] == [0, 0, 400, 400, 0]
    assert [r["n_removed"] for r in suffix_dedup.repeats(docs, match=200).orderBy("doc_id").collect()] == [399, 399, 400, 400, 0]


def test_difference_cover():
    for most in (7, 60, 320):
        v, cover = suffix_dedup.difference_cover(most)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_suffix_classes_are_compared_by_bytes(monkeypatch):
    """Keys that collide, here all of them, make nothing a repeat."""
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 101, 500, np.uint8).tobytes()
    texts = [rng.integers(97, 101, 700, np.uint8).tobytes() + passage, passage + rng.integers(97, 101, 650, np.uint8).tobytes(), b"a" * 500]
    monkeypatch.setattr(suffix_dedup, "mix64", lambda x: x % np.uint64(3))
    block = suffix_dedup.Block(b"".join(texts), [len(t) for t in texts], 400)
    at, of, first, twice, asked = block.classes(b"\xff" * 64, b"\xff" * 64)
    raw = b"".join(texts)
    for p, c in zip(at.tolist(), of.tolist(), strict=True):
        assert raw[p : p + 400] == raw[first[c] : first[c] + 400]
    assert asked.all() and twice.sum() <= len(first)


def test_suffix_buckets_resolve_ties_by_ranks():
    """The same answer from letters and ranks as from the whole strings, for suffixes of any residues."""
    import pyarrow as pa

    match = 60
    v, shifts = suffix_dedup.narrow_cover(match)
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 99, 300, np.uint8)
    raw = np.concatenate([raw[:90], raw[40:150], raw[:80], rng.integers(97, 99, 40, np.uint8), raw[50:140]])
    block = suffix_dedup.Block(raw.tobytes(), [len(raw)], match)
    at = np.arange(len(raw) - match + 1)
    depth = match - v + 1
    ranks = np.unique(block.strings(np.arange(len(raw) - depth + 1), depth), return_inverse=True)[1][at[:, None] + shifts[at % v]]
    both = [block.strings(x, v - 1).view(np.uint8).reshape(len(at), v - 1) for x in (at, at + depth)]
    letters = np.ascontiguousarray(np.concatenate(both, axis=1)).view(f"S{2 * (v - 1)}").ravel()
    small = suffix_dedup._small
    table = pa.table({"block": [1], "bucket": pa.array([0], pa.int32()), "n": pa.array([len(at)], pa.int32()), "letters": [small(letters)], "ranks": [small(np.ascontiguousarray(ranks.T))], "residues": [small((at % v).astype(np.uint16))]})
    got = suffix_dedup._unpacked(suffix_dedup._resolved(match)(table).column("found")[0].as_py(), len(at))
    seen = Counter(raw[k : k + match].tobytes() for k in at)
    want = [seen[raw[k : k + match].tobytes()] > 1 for k in at]
    assert got.tolist() == want and any(want) and not all(want)


def stretches(raw, at, match, n):
    """Slices of the suffixes of a block of its own: bucket, suffixes in each run, bytes."""
    row = {"bytes": raw, "places": suffix_dedup._steps(at), "wanted": len(at)}
    asked = suffix_dedup.Asked(row, match)
    return asked.buckets(n), list(asked.stretches(asked.buckets(n)))


def test_suffixes_go_to_buckets_as_stretches():
    """Equal suffixes of two blocks meet in a bucket, and neighbours take little more room than the text they are in."""
    match, rng = 400, np.random.default_rng(8)
    shared = rng.integers(97, 123, 40_000, np.uint8).tobytes()
    a, b = shared, rng.integers(97, 123, 777, np.uint8).tobytes() + shared
    at = np.arange(len(shared) - match + 1)
    (of_a, parts), (of_b, _) = stretches(a, at, match, 64), stretches(b, at + 777, match, 64)
    assert (of_a == of_b).all() and len(set(of_a.tolist())) > 32
    assert sum(len(data) for _, _, data in parts) < 6 * len(at)  # letters and ranks took 110 bytes each
    for bucket, count, data in parts:
        got, low = [], 0
        for c in count.tolist():
            got += [data[low + k : low + k + match] for k in range(c)]
            low += c + match - 1
        assert low == len(data) and got == [a[k : k + match] for k in at[of_a == bucket]]
    assert stretches(b"", np.zeros(0, np.int64), match, 8)[1] == []


def test_suffixes_are_sorted_in_ranges(monkeypatch):
    """The same answer from many ranges of letters as from one, and as from the whole strings."""
    match, rng = 60, np.random.default_rng(9)
    pool = [rng.integers(97, 99, 150, np.uint8).tobytes() for _ in range(20)] + [b"a" * 150, b"\0" * 150, b"\0" * 90 + b"b" * 60]
    raw = b"".join(pool[k] for k in rng.integers(0, len(pool), 60))
    at = np.sort(rng.choice(len(raw) - match + 1, 3000, replace=False))
    seen = Counter(raw[k : k + match] for k in at)
    want = [seen[raw[k : k + match]] > 1 for k in at]
    assert any(want) and not all(want)
    for most, sparse in ((1 << 19, 256), (200, 16), (40, 1000)):
        monkeypatch.setattr(suffix_dedup, "SORTED", most)
        monkeypatch.setattr(suffix_dedup, "SPARSE", sparse)
        assert suffix_dedup._repeated(suffix_dedup.Block(raw, [len(raw)], match), at).tolist() == want


def test_suffix_ranges_keep_equal_letters_together():
    letters = np.sort(np.array([b"aa", b"ab", b"ab", b"b\0", b"ca", b"cb"], "S2"))
    for heads, wanted in (([], 1), ([], 5), ([b"ab", b"b", b"ca"], 3), ([b"ab"], 9)):
        ranges = suffix_dedup.Ranges(heads, wanted)
        found = ranges.of(letters)
        assert found[1] == found[2] and found.min() >= 0 and found.max() < ranges.buckets
        assert ranges.parts > 1 or (np.diff(found) >= 0).all()


def test_fingerprints(docs, none):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == len(TEXTS)
    prints, order = {}, sorted((d, t or "") for d, t in TEXTS if d not in (2, 6, None))
    for r in rows:
        prints.setdefault((r["n_chars"], r["doc_id"]), set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["fingerprint"] == of[2]["fingerprint"] and of[4]["fingerprint"] == of[5]["fingerprint"]
    t = dict(order)
    n = len(t[12]) // 3
    assert of[12]["edited_sha256"] == hashlib.sha256((t[12][: len(t[12]) - n] + t[11][:n]).encode()).hexdigest()
    assert of[12]["near_edited"] > 0.2 and of[12]["near_next"] == 0
    assert fingerprints.fingerprints(none).count() == 0


def test_fingerprint_likeness_is_generalised_jaccard(spark):
    """Mean over many pairs of weighted sets, all of one similarity."""
    rows = [(k, " ".join([f"a{k}", "b", "c", "d", "e"] * 3 + [f"x{k}", f"y{k}", "b", "c", "d"])) for k in range(300)]
    edited = [(k + 1000, t.rsplit(" ", 7)[0]) for k, t in rows]
    df = spark.createDataFrame(rows + edited, "doc_id long, text string")
    code = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(df).select("doc_id", "fingerprint").collect()}
    same = [sum(code[k][8 * j : 8 * j + 8] == code[k + 1000][8 * j : 8 * j + 8] for j in range(fingerprints.SAMPLES)) / fingerprints.SAMPLES for k, _ in rows]
    a, b = shingles(rows[0][1]), shingles(edited[0][1])
    assert abs(np.mean(same) - sum((a & b).values()) / sum((a | b).values())) < 0.03


def test_fingerprint_likeness_against_brute_force(spark, docs):
    """Every sample of every text anew: the term, and how far its weight was rounded, that make the sample's value least."""
    import struct

    import xxhash

    def xx(value, seed=42):
        raw = value.encode() if isinstance(value, str) else struct.pack("<Q", value % 2**64)
        return xxhash.xxh64(raw, seed=seed).intdigest()

    def samples(text):
        words = [xx(w) for w in text.lower().split()]
        grams = Counter()
        for gram in [words[k : k + 5] for k in range(len(words) - 4)] or ([words] if words else []):
            if len(words) >= 5:
                h = 42
                for w in gram:
                    h = xx(w, h)
            else:  # a shorter text is one term: the hash of the array of its words
                h = 42
                for w in gram:
                    h = xx(w, h)
            grams[h] += 1
        out = []
        for k in range(fingerprints.SAMPLES):
            best = None
            for term, weight in grams.items():
                u = [((xx(term ^ (0x9E3779B97F4A7C15 * (5 * k + j + 1) % 2**63)) >> 11) + 0.5) * 2.0**-53 for j in range(5)]
                r, c, b = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
                t = np.floor(np.log(weight) / r + b)
                best = min(best, (np.log(c) - r * (t - b) - r, term, t)) if best else (np.log(c) - r * (t - b) - r, term, t)
            out.append(best and best[1:])
        return out

    some = sorted((d, t or "") for d, t in TEXTS if d not in (2, 6, 12, None))
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs.where("doc_id NOT IN (2, 6, 12)")).collect()}
    assert len(rows) == len(some)
    for k, (d, text) in enumerate(some):
        after = some[k - 1][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, cut, other = samples(text), samples(edited), samples(after)
        assert rows[d]["near_edited"] == sum(x == y for x, y in zip(own, cut, strict=True)) / fingerprints.SAMPLES, d
        assert rows[d]["near_next"] == sum(x == y for x, y in zip(own, other, strict=True)) / fingerprints.SAMPLES, d


def probability_jaccard(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def classes_of(texts, least):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or probability_jaccard(sets[i], sets[j]) >= least:
                parent = [parent[j] if p == parent[i] else p for p in parent]
    return parent


def test_minhash(spark, docs, none):
    near = [(100 + k, " ".join(w if r.random() > 0.01 else "zzz" for w in prose(9, 200).split())) for k, r in ((k, random.Random(k)) for k in range(25))]
    rows = [(d, t) for d, t in TEXTS if d is not None] + near
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    parent = classes_of([t for _, t in rows], minhash.SIMILARITY)
    least = {p: min(d for (d, _), q in zip(rows, parent, strict=True) if q == p) for p in parent}
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter((d, least[p]) for (d, _), p in zip(rows, parent, strict=True))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    one = minhash.keep_one(docs)
    assert one.columns == docs.columns
    kept = [tuple(r) for r in one.where("doc_id is not null").select("doc_id", "text").collect()]
    assert len(kept) == len(set(kept)) and {d for d, _ in kept} == {least[p] for (d, _), p in zip(rows, parent, strict=True) if d < 100}
    assert minhash.classes(none).count() == 0


def test_probability_jaccard():
    r = random.Random(1)
    for _ in range(200):
        a, b = (Counter(r.choices(range(12), k=r.randrange(1, 20))) for _ in range(2))
        sides = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        assert minhash.probability_jaccard(*sides) == pytest.approx(probability_jaccard(a, b))


def test_sketch_estimates_probability_jaccard():
    a, b = Counter({k: 1 + k % 3 for k in range(60)}), Counter({k: 1 + k % 2 for k in range(20, 75)})
    same = []
    for s in range(40):
        number, ids, w = zip(*[(n, (k + 1000 * s) * 7919 + 13, c) for n, x in enumerate((a, b)) for k, c in x.items()], strict=True)
        held = minhash.sketch(np.array(number), np.array(ids, np.uint64), np.array(w), 2)
        same.append((held[0] == held[1]).mean())
    assert abs(np.mean(same) - probability_jaccard(a, b)) < 0.02


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (50, 100), (60, 60), (70, 80), (80, 90)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {k: 0 for k in range(41)} | {50: 50, 100: 50, 70: 70, 80: 70, 90: 70}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:160] = x[0] + rng.normal(size=(60, 8)) * 0.05  # a large group of near vectors
    x[160:170] = x[1] * 2  # scaled copies
    x[170:180] = x[2]  # copies
    rows = [(k, v.tolist(), int(k % 2) if 200 <= k < 280 else 0) for k, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, x[2].tolist(), None), (304, [1.0, None] * 4, 0), (305, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit("clash"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:300]])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    part = np.arange(300)
    for i, j in zip(*np.nonzero(near), strict=True):
        part[part == max(part[i], part[j])] = min(part[i], part[j])
    want = {k: (int(near[k].sum()), int(part[k]), part[k] == k) for k in range(300)} | {k: (0, k, True) for k in range(300, 306)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quality(spark, none):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        words = prose(1000 + k, r.randrange(20, 200)).split()
        bad = k % 4 == 0
        if bad:
            words = [w + r.choice(("%%%", "###", "$$$")) for w in words] if k % 8 else [w for w in words[:20] for _ in range(6)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), 0))
    labels += [(0, None, 0), (7777, 1, 0)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x y z"), (5, "again")], "doc_id long, text string")
    got = quality.train_and_score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 244 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    of = dict(labels[:240][k][:2] for k in range(240))
    held = [x for x in got if x["held_out"] and x["doc_id"] in of and x["doc_id"] != 5]
    assert held and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got if x["doc_id"] is not None)
    assert np.mean([x["predicted"] == of[x["doc_id"]] for x in held]) > 0.97
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x["score"] for x in quality.train_and_score(docs.limit(3), empty).collect()} == {0.5}
    assert quality.train_and_score(none, empty).count() == 0


def test_quality_against_plain_discriminant(spark):
    r = random.Random(5)
    texts = [(k, prose(500 + k, r.randrange(1, 120)) + (" !!! ||| 777 ABC" * r.randrange(9) if k % 3 else "")) for k in range(150)] + [(None, None), (7, "")]
    labels = [(k, int(k % 3 == 0)) for k in range(120)] + [(3, None), (4, 2), (5, 1)]
    got = quality.train_and_score(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    x = {k: [] for k in (0, 1)}
    for d, t in texts:
        for e, y in labels:
            if d == e and y in x and zlib.crc32(str(d).encode()) % 3 != 1:
                x[y].append(quality.statistics(t or ""))
    x = {k: np.array(v) for k, v in x.items()}
    n = sum(map(len, x.values()))
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / n

    def density(v, k):
        own = (1 - quality.POOLED) * np.cov(x[k].T, bias=True) + quality.POOLED * pooled
        own = (1 - quality.DIAGONAL) * own + quality.DIAGONAL * np.diag(np.diag(own)) + quality.FLOOR * np.eye(len(own))
        d = v - x[k].mean(axis=0)
        return np.log(len(x[k]) / n) - (d @ np.linalg.solve(own, d) + np.linalg.slogdet(own)[1]) / 2

    def score(t):
        v = np.array(quality.statistics(t or ""))
        return 1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -700, 700)))

    want = sorted((repr(d), round(float(score(t)), 9)) for d, t in texts)
    assert sorted((repr(r["doc_id"]), round(r["score"], 9)) for r in got) == want


def test_line_dedup(spark, docs, none):
    line, other = "This line is repeated in many documents.", "Another one with five words."
    rows = [(3, f"Own start of this document here.\n{line}\nEnd."), (1, f"First text that stands alone. {line.upper()}"), (2, f"{line} {other} {line}"), (2, f"{line} {other} {line}"), (4, None), (5, ""), (6, "short one"), (7, "short one"), (8, f"  {other}  ")]
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(1))).collect()}
    text = dict(rows)

    def cut(d):
        return line_dedup.keep_rest(text[d], [tuple(s) for s in got[d]["spans"]])

    assert cut(1) == text[1] and cut(3) == "Own start of this document here.\n\nEnd."
    assert cut(2).split() == other.split() and got[2]["n_removed"] == 2
    assert cut(8).strip() == "" and [got[d]["n_removed"] for d in (4, 5, 6, 7)] == [0] * 4
    assert line_dedup.dedup(docs).where("doc_id is not null").count() >= 12 and line_dedup.dedup(none).count() == 0


def cut_texts(spark, rows, **kw):
    """Each row's text without the removed spans, by id."""
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}
    spans = {d: [tuple(s) for s in r["spans"]] for d, r in got.items()}
    assert all(a + n < b for s in spans.values() for (a, n), (b, _) in zip(s, s[1:], strict=False))
    assert all(r["removed_chars"] == sum(n for _, n in spans[d]) and r["n_removed"] == len(spans[d]) for d, r in got.items())
    return {d: line_dedup.keep_rest(t or "", spans[d]) for d, t in rows}


@pytest.mark.parametrize("line_words", [1, 5])
def test_line_dedup_against_brute_force(spark, line_words):
    r = random.Random(12)
    sentences = ["Dusk fell.", "The keeper lit the lamp again at dusk.", "the  keeper lit the lamp again at DUSK.", "No.", "Ropes and sails were stored below the deck.", "Was it the storm that took them?", "a b c d"]
    rows = [(r.choice([None, *range(25)]), r.choice([" ", "\n", "\n\n"]).join(r.choice(sentences) for _ in range(r.randrange(7)))) for _ in range(60)]
    rows += rows[:5] + [(90, None), (91, "")]
    got = Counter()
    for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), line_words=line_words).collect():
        got[x["doc_id"], x["n_chars"], x["n_removed"], x["removed_chars"]] += 1
    # Every occurrence of every unit, ranked by id, text (by Spark's hash, as documented) and place.
    texts = {(d, t or "") for d, t in rows}
    order = {t: h for t, h in spark.createDataFrame([(t,) for t in {t for _, t in texts}], "t string").select("t", F.xxhash64("t")).collect()}
    places = {}
    for d, t in texts:
        for at, n, digest in line_dedup.units(t, line_words):
            places.setdefault(digest, []).append(((d is None, d or 0, order[t], at), (d, t), (at, n)))
    gone = {k: set() for k in texts}
    for found in places.values():
        first = min(found)[0]
        for place, owner, (at, n) in found:
            if place != first:
                gone[owner] |= set(range(at, at + n))
    want = Counter()
    for (d, t), cut in gone.items():
        want[d, len(t), sum(k - 1 not in cut for k in cut), len(cut)] += 1
    assert {k[:2] for k in got} == {k[:2] for k in want} and sum(got.values()) == sum(want.values())
    # Spans that touch stay apart in the result and are one run here.
    assert Counter({(k[0], k[1], k[3]): 0 for k in got}) == Counter({(k[0], k[1], k[3]): 0 for k in want})
    assert sorted(k[3] for k in got.elements()) == sorted(k[3] for k in want.elements())


def test_line_dedup_takes_whole_lines_of_any_length(spark, tmp_path):
    from passage_engine.llm.queries import QUERIES

    rows = [(1, "Head one.\nAll rights reserved.\nIt is. Of it. No, the one."), (2, "Head two.\nall  rights reserved.\nIt is. Of it. No, the one.\nles."), (3, "It is. les.\nles.")]
    assert cut_texts(spark, rows, line_words=1) == {1: rows[0][1], 2: "Head two.\n\n\nles.", 3: "It is. les.\n"}
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed_chars"] for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: len("all  rights reserved.It is. Of it. No, the one."), 3: len("les.")}


def test_line_dedup_takes_passages_with_short_sentences(spark):
    passage = "The keeper lit the old lamp. Dusk fell. The storm took both sails. Ropes held."
    rows = [(1, f"Some own words come before it. {passage} And more words follow it here."), (2, f"Quite other words stand in front. {passage} Then something else comes after it."), (3, "First line of a\nwrapped paragraph.\n\nTail one."), (4, "First line\nof a wrapped\nparagraph.\n\nTail two.")]
    got = cut_texts(spark, rows)
    assert got[1] == rows[0][1] and got[2].split() == "Quite other words stand in front. Then something else comes after it.".split()
    assert got[3] == rows[2][1] and got[4] == "\n\nTail two."


def test_line_dedup_ranks_null_ids_last(spark):
    line, other = "This line is repeated in many documents.", "Another one with five words."
    rows = [(None, f"{line} {other}"), (None, f"{other} And one more that is long."), (1, line)]
    got = {r["n_chars"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {n: line_dedup.keep_rest(t, [tuple(s) for s in got[n]["spans"]]).strip() for n, t in ((len(t), t) for _, t in rows)}
    assert len(got) == 3 and left[len(line)] == line
    pair = left[len(rows[0][1])], left[len(rows[1][1])]
    assert pair in ((other, "And one more that is long."), ("", rows[1][1]))


def test_sample_of_equal_t_is_one_value_whatever_the_weight(spark):
    k, w = 3, 1.0 + 1e-9  # a weight so near to 1 that t stays 0
    rows = spark.range(2000).select(F.expr(fingerprints.sample("id", "0.0D", k)).alias("one"), F.expr(fingerprints.sample("id", f"{float(np.log(w))!r}D", k)).alias("more"))
    assert rows.where("one <> more").count() == 0


def test_minhash_tells_texts_of_one_name_apart(spark, monkeypatch):
    rows = [(k, prose(300 + k, 60)) for k in range(40)] + [(k + 40, prose(300 + k, 60)) for k in range(5)]
    rows += [(k + 60, prose(300 + k, 60).rsplit(" ", 1)[0] + " zzz") for k in range(5)]
    want = {d: (d if d < 40 else (d - 40) % 20) for d, _ in rows}
    monkeypatch.setattr(minhash, "_vertex", lambda text: F.xxhash64(text).bitwiseAND(7))
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_deals_the_members_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 3)
    base = prose(31, 120).split()
    rows = [(k, " ".join(w if j != 3 * k else "zzz" for j, w in enumerate(base))) for k in range(30)] + [(99, prose(77, 120))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: (0 if d < 99 else 99) for d, _ in rows}


def test_minhash_of_null_ids(spark):
    a, b = prose(21, 200), prose(22, 200)
    near_a, near_b = a.rsplit(" ", 1)[0] + " zzz", b.rsplit(" ", 1)[0] + " zzz"
    rows = [(1, a), (None, near_a), (None, b), (None, near_b), (None, b), (2, prose(23, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.classes(df).where("doc_id is not null or component_id is not null").collect())
    assert got == Counter([(1, 1, True), (None, 1, False), (2, 2, True)])
    kept = [r["text"] for r in minhash.keep_one(df).collect()]
    assert len(kept) == 3 and {a, rows[-1][1]} < set(kept) and set(kept) & {b, near_b}
