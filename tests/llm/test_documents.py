"""Corpus operators on documents against brute force, and on odd inputs."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from laurel.llm import cgk, licenses, mixing, quality, simhash, suffix_trees, unigram

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def both(name):
    return pytest.mark.parametrize("docs", ["odd_docs", "sf_docs"], ids=lambda v: f"{name}-{v}")


def expected_repeats(docs, window=35):
    words = [WORD.findall(t) for _, t in docs]
    starts = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@both("repeats")
@pytest.mark.parametrize("group", [2, 256])
def test_substring_dedup(request, docs, group, monkeypatch):
    docs = request.getfixturevalue(docs)
    monkeypatch.setattr(suffix_trees, "GROUP", group)  # both ways: trees, and longer prefixes
    got = suffix_trees.remove_repeats(docs).select("row.doc_id", "deduped.n_words", "deduped.n_removed", "deduped.kept")
    assert collections.Counter(rows_of(got)) == collections.Counter(expected_repeats(texts_of(docs)))


def expected_prints(docs):
    out = []
    for doc_id, text in docs:
        w = WORD.findall(text.translate(LOW))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    return out


@both("simhash")
@pytest.mark.parametrize("piece", [2, 1024])
def test_simhash(request, docs, piece, monkeypatch):
    docs = request.getfixturevalue(docs)
    monkeypatch.setattr(simhash, "SLICE", piece)  # both ways: whole groups, and slices that meet in pairs
    prints = expected_prints(texts_of(docs))
    codes = sorted({p for _, p in prints})
    root = {p: p for p in codes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for doc_id, p in prints:
        least[find(p)] += [doc_id] if doc_id is not None else []
    want = collections.Counter((d, f"{p:016x}", min(least[find(p)], default=None)) for d, p in prints)
    assert collections.Counter(rows_of(simhash.simhash_components(docs))) == want
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {c for _, _, c in want} <= ids | {None}


def test_gray_index_finds_every_link():
    draw = np.random.default_rng(5)
    seeds = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(1) << draw.integers(0, 64, 300, dtype=np.uint64) for _ in range(3)]
    codes = np.unique(np.concatenate([seeds, np.repeat(seeds, 8)[:300] ^ flips[0] ^ flips[1] ^ flips[2]]))
    index = simhash.GrayIndex(codes)
    roots = index.roots()
    label = list(range(len(codes)))
    for i, a in enumerate(index.codes.tolist()):
        for j, b in enumerate(index.codes.tolist()[:i]):
            if (a ^ b).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    assert len(set(zip(roots.tolist(), label, strict=True))) == len(set(label)) == len(set(roots.tolist()))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = dict(rows_of(simhash.components(chain)))
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


@both("mix")
def test_mixing(request, docs):
    docs = request.getfixturevalue(docs)
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert collections.Counter(map(str, got)) == collections.Counter(str(r.asDict()) for r in mixing.mix(docs).collect())
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    wanted, full = 1.5 * sum(size.values()), set()
    while True:
        level = (wanted - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["taken"]
        want = 2 * size[r["source"]] if r["source"] in full else weight[r["source"]] * level
        assert r["target"] == pytest.approx(want)
        size_target = want
        assert abs(size_target - want) < 1e-9
    for s in names:
        want = 2 * size[s] if s in full else weight[s] * level
        assert abs(taken[s] - want) <= max(0.01 * want, mixing.BLOCK)


@both("quality")
def test_quality(request, docs):
    docs = request.getfixturevalue(docs)
    measured = quality.with_stats(docs)
    judged = quality.with_verdict(measured, quality.thresholds(measured), into="verdict").collect()
    assert len(judged) == docs.count()
    for r in judged:
        text = r.text or ""
        words = WORD.findall(text)
        lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
        for line in lines:
            dup += line in seen
            seen.add(line)
        triples = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {
            j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)
        }
        want = (len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(lines))
        assert tuple(r.stats) == want
        if len(words) < 50 or 100 * len(covered) > 50 * len(words):
            assert not r.verdict
    assert quality.quality_filter(docs).columns == docs.columns


def test_quality_keeps_clean_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("doc_id", "label_id")
    measured = quality.with_stats(docs)
    judged = quality.with_verdict(measured, quality.thresholds(measured)).join(labels, docs.doc_id == labels.label_id)
    long = [r for r in judged.select("kept", "quality", "stats").collect() if r.stats.n_words >= 50]
    good = [r.kept for r in long if r.quality == 1]
    bad = [r.kept for r in long if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


@both("licences")
def test_licenses(request, docs):
    docs = request.getfixturevalue(docs)
    words_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = collections.Counter()
    for doc_id, text in texts_of(docs):
        words, starts, labels = words_of.findall(text.translate(LOW)), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        want[doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))] += 1
    got = licenses.license_scan(docs).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_suppression():
    text = b"Under the GNU General Public License, version 2 or (at your option) any later version."
    n_words, n_base, first, last, base, labels, score = licenses.scan(text)
    assert (n_base, first, last, base) == (1, 2, 2, "gpl")
    assert labels == "gpl,gpl-2-or-later" and score == 0.95  # the shorter gpl-2 lies inside and is suppressed
    assert licenses.scan(b"accord mitigate commit license")[5] == ""
    assert len(licenses.rules()) >= 200
    hits = [(2, 0, 10, 1), (1, 2, 5, 2), (2, 0, 10, 3), (2, 3, 6, 4), (1, 8, 12, 5)]
    assert sorted(licenses.unsuppressed(hits)) == [(1, 8, 12, 5), (2, 0, 10, 1), (2, 0, 10, 3)]


def test_decontamination_finds_edited_items(spark, sf_docs):
    draw = np.random.default_rng(3)
    items = [(i, " ".join(f"q{i}t{j}" for j in range(8 + i))) for i in range(40)] + [(40, None), (41, "too short")]
    filler = [f"f{j}" for j in range(400)]
    rows = [(1000, None, "x"), (1001, "", "x"), (None, " ".join(filler), "x")]
    for i, text in items[:40]:
        words = text.split()
        for at in draw.choice(len(words), cgk.edits_allowed(len(words)), replace=False).tolist():
            words[at] = "changed"
        rows.append((i, " ".join(filler[:50] + [w.upper() + "," for w in words] + filler[50:90]), "x"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    got = cgk.contaminations(docs, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert all(d == i for d, i in found)
    assert len(found) >= 0.9 * 40  # recall of the hashing at full tolerance
    kept = cgk.without_benchmark(docs, bench)
    assert kept.columns == docs.columns and {1000, 1001, None} <= {r.doc_id for r in kept.collect()}
    assert cgk.contaminations(docs, bench.limit(0)).count() == 0
    assert cgk.contaminations(docs.limit(0), bench).count() == 0


def test_decontamination_is_exact_on_verbatim_items(spark, sf_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    words = lambda t: " " + " ".join(w.decode() for w in cgk.words_of((t or "").encode())) + " "
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = {(d, i) for d, t in texts_of(sf_docs) for i, item in items if item in words(t)}
    assert want <= {(r.doc_id, r.item_id) for r in cgk.contaminations(sf_docs, bench).collect()}


def test_best_place_is_the_edit_distance():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 2, 7, 4, 9])
    assert cgk.best_place(a, b) == (1, 1)


@both("tokens")
def test_token_counts_match_the_tokenizer(request, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    docs = request.getfixturevalue(docs)
    path = unigram.default_vocabulary()
    pieces, byte_pieces = unigram.load_pieces(path)
    assert byte_pieces
    vocabulary = [("<unk>", 0.0), *pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always")
    want = collections.Counter((d, len(t), len(tokenizer.encode(t).ids)) for d, t in texts_of(docs))
    assert collections.Counter(rows_of(unigram.token_counts(docs, path))) == want


def test_unigram_ties_take_the_longest_piece():
    pieces = [(unigram.MARK, -1.0), ("a", -1.0), ("aa", -2.0), ("b", -3.0), ("ab", -4.0)]
    model = unigram.Unigram(pieces, byte_pieces=False)
    assert model.count("aa") == 2 and model.count("ab") == 2 and model.count("??a") == 3
    assert unigram.Unigram(pieces, byte_pieces=True).count("é") == 3


def test_quality_limits_follow_each_source(spark):
    """Many distinct limits on the given tables; a shift planted in one source moves its limits alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    measured = quality.written(quality.with_stats(docs).drop("text"), "test-quality")

    def limits_of(table):
        return {(r.g_lang, r.g_source): r.asDict() for r in quality.thresholds(table).collect()}

    plain = limits_of(measured)
    for name in quality.TAILS:
        assert len({row[f"{name}_most"] for row in plain.values()}) >= 10, name
    planted = max(r.source for r in docs.select("source").distinct().collect() if r.source)
    more = F.struct(*(
        (F.col(f"stats.{c}") + F.when(F.col("source") == planted, F.col("stats.word_chars") / 10).otherwise(0)).cast("long").alias(c)
        if c == "n_symbols" else F.col(f"stats.{c}") for c in measured.schema["stats"].dataType.names
    ))
    shifted = limits_of(measured.withColumn("stats", more))
    for key, row in shifted.items():
        moved = row["symbols_most"] - plain[key]["symbols_most"]
        assert (moved >= 10) if key[1] == planted else (moved < 5), (key, moved)
        assert row["repeats_most"] == plain[key]["repeats_most"]


@pytest.mark.parametrize("name", ["repeats", "simhash", "mix", "licences", "quality", "tokens"])
def test_empty_table(spark, odd_docs, name):
    empty = odd_docs.limit(0)
    run = {
        "repeats": suffix_trees.remove_repeats, "simhash": simhash.simhash_components, "mix": mixing.mix,
        "licences": licenses.license_scan, "quality": quality.quality_filter,
        "tokens": lambda d: unigram.token_counts(d, unigram.default_vocabulary()),
    }[name]
    assert run(empty).count() == 0


def test_kept_digest(spark):
    docs = spark.createDataFrame([(1, "b  a\tb")], "doc_id bigint, text string")
    kept = suffix_trees.remove_repeats(docs).select("deduped.kept").first()[0]
    assert hashlib.sha256(kept.encode()).hexdigest() == hashlib.sha256(b"b a b").hexdigest()
