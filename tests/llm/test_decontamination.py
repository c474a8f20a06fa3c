"""Decontamination at the limits of its method: class bounds, verbatim and long items."""

import numpy as np
import pytest

from laurel.llm import cgk


def replaced(codes, draw):
    out = codes.copy()
    out[draw.choice(len(out), cgk.edits_allowed(len(out)), replace=False)] = 0
    return out


@pytest.mark.parametrize("lengths", [(9, 10), (14, 15), (19, 20), (29, 30)])
def test_count_of_sequences_is_lossless_in_classes_that_cross_a_step(lengths):
    draw = np.random.default_rng(5)
    items = cgk.Items([(i, " ".join(f"v{v}" for v in draw.integers(0, 3000, lengths[i % 2]))) for i in range(60)])
    assert list(items.classes) == [lengths[0]]
    for members in items.classes.values():
        for number in members:
            for _ in range(5):
                window = replaced(items.items[number][1], draw)
                codes = np.concatenate([window, np.zeros(3 * items.longest, np.int64)])
                known = items.filter[cgk.gram_cells(codes)] & (codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0)
                assert known[: len(window)].sum() >= items.least_shared(members)
                assert cgk.shared_grams(len(window)) >= items.least_shared(members)


def test_longer_item_of_a_class_is_found_with_few_sequences_left():
    texts = [" ".join(f"a{j}" for j in range(9)), " ".join(f"b{j}" for j in range(10))]
    items = cgk.Items(list(enumerate(texts)))
    changed = [f"x b0 b1 b2 b3 y{i} b5 b6 z b8 b9 x" for i in range(5)]  # two edits, two sequences of eight left
    assert all(hit[0][0] == 1 and hit[0][2] == 2 for hit in items.search([c.encode() for c in changed]))


@pytest.mark.parametrize("n", [5, 6, 7, 8, 40])
def test_verbatim_items_are_found_before_any_next_words(n):
    draw = np.random.default_rng(n)
    texts = [" ".join(f"v{v}" for v in draw.integers(0, 300, n)) for _ in range(300)]
    items = cgk.Items(list(enumerate(texts)))
    after = [" ".join(f"v{v}" for v in draw.integers(0, 300, 20)) for _ in texts]  # all words of the vocabulary
    found = items.search([f"{b} {t} {a}".encode() for t, a, b in zip(texts, after, reversed(after), strict=True)])
    assert all((i, 20, 0) in hits for i, hits in enumerate(found))
    assert items.search([texts[0].encode(), b"", texts[1].encode()])[::2] == [[(0, 0, 0)], [(1, 0, 0)]]


def test_samples_lie_inside_the_items():
    assert all(max(cgk.sampled_places(size, r)) < size for size in (8, 9, 30, 400) for r in range(200))


def test_long_edited_items_are_all_found():
    draw, n = np.random.default_rng(3), 3000
    rows, docs = [(90, " ".join(f"short{j}" for j in range(20)))], ["before after " * n]
    for i in range(6):
        codes = draw.integers(1, 400, n)
        rows.append((i, " ".join(f"i{i}w{v}" for v in codes)))
        changed = [f"i{i}w{v}" if v else "changed" for v in cgk.mutated(codes, cgk.edits_allowed(n), draw)]
        docs.append(" ".join(["before"] * 30 + changed + ["after"] * 30))
    items = cgk.Items(rows)
    none, *found = items.search([d.encode() for d in docs])
    assert none == [] and [[items.items[h[0]][0] for h in hits] for hits in found] == [[i] for i in range(6)]
    assert all(hits[0][2] <= cgk.edits_allowed(n) for hits in found)
    assert min(items.recall.values()) >= cgk.RECALL


def test_classes_without_walks_match_brute_force(monkeypatch):
    monkeypatch.setattr(cgk, "RECALL", 1.01)  # beyond what walks can reach
    monkeypatch.setattr(cgk, "MOST_REPETITIONS", 1)
    draw = np.random.default_rng(9)
    rows = [(i, " ".join(f"v{v}" for v in draw.integers(0, 40, n))) for i, n in enumerate(draw.integers(8, 40, 30).tolist())]
    docs = []
    for _, text in rows:
        words = text.split()
        for at in draw.integers(0, len(words), cgk.edits_allowed(len(words))).tolist():
            words[at : at + 1] = [[], ["v1"], ["new", "new"]][int(draw.integers(3))]
        docs.append(" ".join([*(f"v{v}" for v in draw.integers(0, 40, 30)), *words, "end"]))
    items = cgk.Items(rows)
    assert not items.tables and items.exact
    coded = [np.array([items.vocabulary.get(w.encode(), 0) for w in d.split()], np.int64) for d in docs]
    want = [{n for n, (_, item) in enumerate(items.items) if cgk.best_place(item, c)[0] <= cgk.edits_allowed(len(item))} for c in coded]
    assert [{h[0] for h in hits} for hits in items.search([d.encode() for d in docs])] == want
