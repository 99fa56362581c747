import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from agriclime.llm import variants
from agriclime.sources.tables import materialize


def edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point lies between them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, out = {}, {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and edit(v, w)]
        top = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = len(near)
        if top and n[top] >= 10 * n[w]:
            form[w] = top
    result = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        result.add((w, form.get(w), root, n[w], out[w], n[form[w]] if w in form else None))
    return result


def corpus(seed, size=300):
    """Words of few syllables and their misspellings; odd letters, copies, nulls, one hot document."""
    draw = random.Random(seed)
    syllables = ["an", "the", "ré", "tion", "ÿa", "b", "Ög", "ssa", "×e"]
    base = ["".join(draw.choices(syllables, k=draw.randint(3, 5))) for _ in range(60)]

    def word():
        w = draw.choice(base)
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            i = draw.randrange(len(w))
            w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice("aétÿ") + w[i:], w[:i] + draw.choice("aéb") + w[i + 1 :]])
        return w if draw.random() < 0.9 else w.upper()

    rows = [(i, draw.choice([" ", ", ", "\n", "9"]).join(word() for _ in range(draw.randint(0, 40)))) for i in range(size)]
    rows += [(i, "antheran " * 30 + "antheram anthera") for i in (3, 3, 5, -7)] + [(None, "antheran ssassassa"), (8, None), (9, "")]
    return rows


def found(spark, documents, rows, **options):
    result = variants.variants(documents(rows), **options)
    assert result.dtypes == [
        ("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint"),
    ]
    listed = [tuple(r) for r in result.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


def test_words_equal_brute_force(spark, documents):
    rows = corpus(1)
    expected = brute_force(rows)
    assert sum(r[1] is not None for r in expected) > 20 and max(r[4] for r in expected) > 3
    assert found(spark, documents, rows) == expected


def test_cells_and_parts_change_nothing(spark, documents, monkeypatch):
    """Coarse trees fitted on few words, overfull cells, small leaves and steps."""
    monkeypatch.setattr(variants, "LEAF", 2)
    monkeypatch.setattr(variants, "STEP_WORDS", 7)
    monkeypatch.setattr(variants, "STEP_LETTERS", 50)
    rows = corpus(2)
    assert found(spark, documents, rows, sample=100, cell_words=5) == brute_force(rows)


def test_chains_of_forms(spark, documents):
    """Frequencies ten times apart, one edit each: roots follow to the last."""
    words = ["aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    rows = [(7 * k + 1, " ".join([w] * 2 * 11**k)) for k, w in enumerate(words)]
    expected = brute_force(rows)
    assert max(sum(1 for r in expected if r[2] == root) for root in {r[2] for r in expected}) == 4
    assert found(spark, documents, rows) == expected


def test_equal_letter_counts_and_very_long_words(spark, documents):
    """Anagrams share a vector that no split can part; words of 300 and 100,000 letters."""
    draw = random.Random(5)
    anagrams = list({"".join(draw.sample("abcdefg", 7)) for _ in range(150)})
    long = ["z" * 300, "z" * 150 + "y" + "z" * 149, "z" * 301, "x" * 100_000, "x" * 99_999 + "y", "x" * 50_000 + "é" + "x" * 50_000]
    rows = [(i, " ".join([*anagrams, *(a[:3] + "h" + a[3:] for a in anagrams[:20]), *long])) for i in range(3)]
    assert found(spark, documents, rows, cell_words=16) == brute_force(rows)


def test_empty_table(spark, documents):
    assert found(spark, documents, []) == set()
    assert found(spark, documents, [(1, None), (2, "short words"), (3, "singleword")]) == set()


@pytest.mark.parametrize("replace", [True, False])
def test_search_reaches_every_pair_and_prunes(replace):
    """Every pair is met once; most leaves are not visited."""
    rng = np.random.default_rng(4)
    made = {bytes(rng.choice(np.frombuffer(b"abcdefghijklmnop", np.uint8), 9 + (not replace))) for _ in range(3000)}
    made |= {w[:i] + b"q" + w[i + 1 :] for w in list(made)[:400] for i in (1, 5)}
    words = sorted(w.decode() for w in made)
    shorter = words if replace else sorted({w[:i] + w[i + 1 :] for w in words[:400] for i in (0, 4, 9)})
    cell = variants.Cell(words, np.ones(len(words), np.int64))
    row, leaf = cell.tree.search(variants.letter_counts(variants.letters(shorter)), replace)
    pairs = set(zip(row.tolist(), leaf.tolist()))
    assert len(pairs) == len(row)
    leaves = {int(i): n for n, (a, b) in enumerate(cell.tree.span) if cell.tree.letter[n] < 0 for i in cell.tree.order[a:b]}
    if replace:
        pattern = {}
        for i, w in enumerate(words):
            for j in range(len(w)):
                pattern.setdefault((w[:j], w[j + 1 :]), []).append(i)
        wanted = {(a, b) for g in pattern.values() for a in g for b in g if words[a] < words[b]}
    else:
        at = {w: i for i, w in enumerate(shorter)}
        wanted = {(at[s], i) for i, w in enumerate(words) for j in range(len(w)) if (s := w[:j] + w[j + 1 :]) in at}
    assert wanted and all((a, leaves[b]) in pairs for a, b in wanted)
    assert len(row) < 0.2 * len(shorter) * np.count_nonzero(cell.tree.letter < 0)


def test_roots_double_their_way(spark):
    links = materialize(spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(18)], "word string, form string"))
    assert {tuple(r) for r in variants.roots(links).collect()} == {(f"w{i}", "w18") for i in range(18)}
