"""Filter audit, fill-in-middle and syncmer fingerprints against brute force, on given, odd and empty tables."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from laurel.llm import fill_middle, filter_audit, queries, syncmers

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLACED = "part string, filter_order string, step int"


@pytest.fixture(scope="module")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (5, 1, None), (6, None, 1), (None, 1, 1), (8, 0, 0), (77, 1, 1)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, quality int, toxic int, part string")


def expected_audit(docs, labels):
    """Every order and step played document by document."""
    seen, rows = {}, []
    for doc_id, text, lang in docs:
        if doc_id is not None:
            seen[text or ""] = min(doc_id, seen.get(text or "", doc_id))
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    for doc_id, text, lang in docs:
        text = text or ""
        words = WORDS.findall(text)
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(set("#$%&*|") & set(text)),
            "E": doc_id is not None and text in seen and seen[text] < doc_id,
        }
        rows.append((lang or "", {f for f in failed if failed[f]}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [r[1:] for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[0]]
                redundant = sum(f in r[0] for r in gone)
                left = [r for r in left if f not in r[0]]
                gone += here
                shapley[f] += len(here)
                unique = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, "".join(order), step] = [
                    len(left), len(here), redundant, unique, sum(r[1] for r in here), sum(r[2] for r in here), f
                ]
        for key, value in out.items():
            if key[0] == part:
                value[-1] = shapley[value[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_plays_every_order(spark, odd_docs, odd_labels):
    got = filter_audit.audit(odd_docs, odd_labels).collect()
    want = expected_audit(
        [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()],
        [(r.doc_id, r.quality, r.toxic) for r in odd_labels.collect()],
    )
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.audit(odd_docs.limit(0), odd_labels).count() == 0


def test_matrix_holds_every_word(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 2000)
    local = filter_audit.shards(odd_docs.repartition(3))
    known = {r.number: r.word for r in filter_audit.dictionary(local).collect()}
    assert len(set(known.values())) == len(known)
    places = Counter(n % filter_audit.BUCKETS for n in known)
    assert all(n // filter_audit.BUCKETS < places[n % filter_audit.BUCKETS] for n in known)  # no gaps in a bucket
    found = []
    for shard in filter_audit.global_shards(local).collect():
        start = 0
        ends, columns, counts = (filter_audit.unpacked(v).tolist() for v in (shard.row_end, shard.columns, shard.counts))
        for doc_id, end, total, distinct in zip(shard.doc_id, ends, shard.row_sum, shard.row_nonzero, strict=True):
            cells = dict(zip(columns[start:end], counts[start:end], strict=True))
            assert list(cells) == sorted(cells) and len(cells) == distinct and sum(cells.values()) == total
            found.append((doc_id, sorted((known[c], n) for c, n in cells.items())))
            start = end
    want = [(r.doc_id, sorted(Counter(WORDS.findall(r.text or "")).items())) for r in odd_docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(found, key=key) == sorted(want, key=key)


def expected_middle(doc_id, text):
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    key = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or h[2] % 100 >= 50 or re.search("<[PSM]>", text):
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_on_odd_rows(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text", "kept", "size").unionByName(
        spark.createDataFrame(
            [(i, t, "k", 0) for i in range(100, 180) for t in (" a <S> b", "  lead  and trail \n", "ü< <S <P x" * 9, " ")],
            "doc_id bigint, text string, kept string, size int",
        )
    )
    from pyspark.sql import functions as F

    out = fill_middle.fill_in_middle(rows.withColumn("form", F.lit("mine")))
    assert out.columns == ["doc_id", "text", "kept", "size", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fill_middle.restored("output", "form")).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected_middle(r.doc_id, r.text or "")
        assert r.back == (r.text or "")
    assert fill_middle.fill_in_middle(rows.limit(0)).count() == 0


PIECES = st.lists(
    st.sampled_from(["a", "Wort", "é日", " ", "  ", "\n\t", "x" * 700, "y" * 9000, " " * 600, "a b c " * 150, "<", "q " * 5000]), max_size=12
)


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_chunks_count_and_cut_as_the_pattern_does(pieces):
    text = "".join(pieces)
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    chunks = fill_middle.Chunks(text.encode(), fill_middle.Memo())
    assert chunks.tokens == len(tokens) and chunks.chars == len(text)
    for k in {0, len(tokens), len(tokens) // 2, len(tokens) // 3, 1 if tokens else 0, max(len(tokens) - 1, 0)}:
        head = "".join(tokens[:k])
        assert chunks.cut(k) == (len(head.encode()), len(head))


def test_shared_passages_share_chunks_and_equal_hashes_do_not_count():
    rng = np.random.default_rng(1)
    passage = " ".join(f"w{i}" for i in rng.integers(0, 5000, 20_000)).encode()
    memo = fill_middle.Memo()
    fill_middle.Chunks(b"one start " * 40 + passage, memo)
    before = len(memo.held)
    fill_middle.Chunks(b"another, longer start " * 90 + passage + b" end", memo)
    assert before > 50 and len(memo.held) - before < 10  # all but the first and last chunks of the passage were known
    chunk = b"two words"
    memo.held[hash(chunk)] = (b"something else", fill_middle.Summary(99, True, True, False, 99))
    assert memo.summary(chunk).starts == 2
    small = fill_middle.Memo(most=2000)
    fill_middle.Chunks(passage, small)
    assert small.size <= 2000 and small.size == sum(len(c) for c, _ in small.held.values())


def test_rolls_do_not_depend_on_blocks(monkeypatch):
    data = bytes(np.random.default_rng(2).integers(97, 123, 50_000, dtype=np.uint8))
    whole = fill_middle.ends_of_rolls(data)
    monkeypatch.setattr(fill_middle, "BLOCK", 1000)
    assert fill_middle.ends_of_rolls(data)[fill_middle.ends_of_rolls(data) > 32].tolist() == whole[whole > 32].tolist()


def xx(value, seed=42):
    data = value.encode() if isinstance(value, str) else (value & (1 << 64) - 1).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def chain(values):
    seed = 42
    for v in values:
        seed = xx(v, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def expected_sketch(text, k=syncmers.K, s=syncmers.S):
    unspaced = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
    hashes = [signed(xx(u)) for u in re.findall(rf"[{unspaced}]|[^\x20\x09-\x0D{unspaced}]+", text)]
    if not hashes:
        return {}
    if len(hashes) < k:
        return {chain(hashes): 0}
    first = {}
    for i in range(len(hashes) - k + 1):
        inner = [chain(hashes[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            first.setdefault(chain([*inner[: k - s : s], inner[-1]]), i)
    return dict(sorted(first.items())[: syncmers.SKETCH])


def expected_likeness(a, b):
    union = sorted(a.keys() | b.keys())[: syncmers.SKETCH]
    if not union:
        return 1.0
    shifts = [b[h] - a[h] for h in union if h in a and h in b]
    near = lambda i: any(abs(shifts[i] - x) <= syncmers.SLACK for j, x in enumerate(shifts) if j != i)
    m = sum(near(i) or len(union) == 1 for i in range(len(shifts)))
    return 2 * m / (len(union) + m)


def expected_fingerprints(docs):
    """(doc_id, n_chars, edited digest, fingerprint, edited fingerprint, near_edited, near_next) of all rows, sorted."""
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    key = lambda r: digest(f"{'null' if r[0] is None else r[0]}:{r[1]}")
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is None, -(r[0] or 0), key(r)))
    shown = lambda sk: " ".join(f"{h & (1 << 64) - 1:016x}@{p}" for h, p in sorted(sk.items(), key=lambda x: (x[1], x[0])))
    out = []
    for (doc_id, text), (_, other) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        a, b, c = expected_sketch(text), expected_sketch(edited), expected_sketch(other)
        out.append((doc_id, len(text), digest(edited), shown(a), shown(b), expected_likeness(a, b), expected_likeness(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run", [64, 3])
def test_fingerprints_against_brute_force(spark, odd_docs, tmp_path, monkeypatch, run):
    monkeypatch.setattr(syncmers, "RUN", run)
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_syncmers(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == expected_fingerprints([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_fingerprints_of_given_documents(spark, sf_docs):
    got = queries.op13_syncmers(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == expected_fingerprints([(r.doc_id, r.text) for r in sf_docs.collect()])
    long = [r for r in got if r.n_chars > 2000]
    assert all(0.3 < r.near_edited <= 1 for r in long)
    assert sum(r.near_next == 0 for r in got) > 0.9 * len(got)


@pytest.mark.parametrize("copies", [1, 2, 5])
def test_only_documents_and_copies(spark, monkeypatch, copies):
    monkeypatch.setattr(syncmers, "COPIES", 2)
    docs = spark.createDataFrame([(7, "a b c d e f g h")] * copies, "doc_id bigint, text string")
    got = syncmers.fingerprints(docs).collect()
    assert len(got) == copies and {r.near_next for r in got} == {1.0}
    assert syncmers.fingerprints(docs.limit(0)).count() == 0


def test_anchors_are_context_free_and_cover_every_window(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 300, 400)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:150], "NEW", *words[150:]])), (3, " ".join(words[50:]))]
    rows = syncmers.with_sketch(
        spark.createDataFrame(texts, "doc_id bigint, text string"), "text", "anchors", sketch=10_000
    ).collect()
    a, b, c = ({x.h: x.p for x in r.anchors} for r in rows)
    places = sorted(a.values())
    assert max(np.diff(places)) <= syncmers.K - syncmers.S + 1
    assert {h for h, p in a.items() if p >= 50} <= c.keys()  # cut text: the rest keeps its anchors
    moved = {h for h, p in a.items() if p >= 150}
    assert all(b[h] == a[h] + 1 for h in moved)  # behind an insertion all are there, one place on
