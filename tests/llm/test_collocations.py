import collections
import random
import re

import numpy as np

from lotstack.llm import collocations

DOCS = "doc_id long, text string, lang string, words string, f int"


def brute(docs, at_least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    f = {k: v for k, v in f.items() if v >= at_least}
    out = collections.defaultdict(list)
    inside = collections.Counter()
    for (lang, *words), a in f.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    inside[lang, *words[i:j]] = max(inside[lang, *words[i:j]], a)
    for (lang, *words), a in f.items():
        if len(words) > 1 and 100 * inside[lang, *words] < 100 * a:
            cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, all_ in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(all_)[:top], 1))


def rows(seed, n):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "the", "THE", "Äb", "äb", "x-y", " ", "中"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "]) for _ in range(rng.randrange(80)))
        out.append((i % 50, rng.choice([text, text, text, "", None, text + " the end of the road " * 3]), rng.choice(["en", "en", "de", None, "und"]), "w", 1))
    return out


def found(spark, docs, **parameters):
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    return sorted(map(tuple, collocations.collocations(df, **parameters).collect()))


def test_phrases_equal_brute_force(spark):
    docs = rows(1, 300)
    pairs = [(t, lang) for _, t, lang, _, _ in docs]
    assert len(brute(pairs, 8, 5, 2000)) > 100
    for at_least, longest, top in ((8, 5, 2000), (20, 4, 15), (40, 2, 3)):
        assert found(spark, docs, at_least=at_least, longest=longest, top=top) == brute(pairs, at_least, longest, top)


def test_crowded_buckets_change_nothing(spark):
    docs = rows(2, 120)
    expected = brute([(t, lang) for _, t, lang, _, _ in docs], 6, 5, 50)
    assert expected and found(spark, docs, at_least=6, top=50, bucket_bits=3) == found(spark, docs, at_least=6, top=50, bucket_bits=20) == expected


def test_one_phrase_repeated_very_often_and_long_texts(spark):
    docs = [(1, "so it goes " * 20000, "en", "", 0), (2, "goes so; " * 150, "en", "", 0)] + [(3, "it goes", None, "", 0)] * 120
    assert found(spark, docs) == brute([(t, lang) for _, t, lang, _, _ in docs], 100, 5, 2000)


def test_empty_tables_and_texts(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None, "", 0), (2, " .,\n", "en", "", 0)]) == []


def test_overlapping_runs_count_each_time(spark):
    assert found(spark, [(1, "a " * 150, "x", "", 0)], longest=2) == [("x", 1, "a a", 149, 150, 150, 150, 993)]


def test_words_of_one_hash_start_the_job_anew(spark, monkeypatch):
    docs = rows(4, 60)
    expected = brute([(t, lang) for _, t, lang, _, _ in docs], 5, 3, 40)
    true, first, seeds = collocations.words_of, collocations._first_pass, []

    def poor(data, offsets, seed=0):
        hashes, *rest = true(data, offsets, seed)
        return (hashes & np.uint64(3) if seed == 0 else hashes), *rest

    def tried(bits, at_least, seed):
        seeds.append(seed)
        return first(bits, at_least, seed)

    monkeypatch.setattr(collocations, "words_of", poor)
    monkeypatch.setattr(collocations, "_first_pass", tried)
    assert found(spark, docs, at_least=5, longest=3, top=40) == expected and seeds == [0, 1]
