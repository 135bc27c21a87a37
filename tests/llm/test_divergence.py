"""The source audit against a plain version in whole numbers, and its defined cases."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaweave.llm import divergence

D = "doc_id bigint, text string, lang string, source string"


def plain(rows, least, top):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), l or "", s or "") for _, t, l, s in rows]
    df = collections.Counter((l, w) for ws, l, _ in docs for w in set(ws))
    kept = {k for k, n in df.items() if n >= least}
    count = collections.Counter((l, s, w) for ws, l, s in docs for w in ws if (l, w) in kept)
    out = []
    for lang in {l for _, l, _ in docs}:
        terms, sources = [w for l, w in kept if l == lang], sorted({s for _, l, s in docs if l == lang})
        total = {s: sum(count[lang, s, w] for w in terms) for s in sources}
        p = {(s, w): 1 + 10**9 * (count[lang, s, w] + 5) // (total[s] + 5 * len(terms)) for s in sources for w in terms}
        whole = sum(total.values()) + 5 * len(terms)
        q = {w: 1 + 10**9 * (sum(count[lang, s, w] for s in sources) + 5) // whole for w in terms}
        for s in sources:
            pairs = [(sum(abs(p[s, w] - p[t, w]) for w in terms), t) for t in sources if t != s]
            over = [(p[s, w] - q[w], w) for w in terms if count[lang, s, w] and p[s, w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus():
    rng = np.random.default_rng(5)
    pool = ["Ab", "ab", "ß", "Éa", "é", "x1y", "the", "THE", "日本", "zz-top", "q", "w" * 300, "İ"]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(0, 30))), ["en", "de", None, ""][i % 4], ["a", "b", None, "", "ü", "Z"][int(rng.integers(0, 6))]) for i in range(120)]
    rows += [(None, None, "en", "a"), (7, "12 34 \x00", "xx", "lone"), (7, "alone", "xx", "other"), (8, "ab " * 40000, "en", "hot")]
    rows += [(9, "ab the q", "en", "hot")] * 60
    return rows


@pytest.mark.parametrize(("least", "top"), [(1, 50), (3, 2), (1000, 50)])
def test_audit_against_the_plain_version(spark, least, top):
    rows = corpus()
    docs = spark.createDataFrame(rows, D).repartition(5).withColumns({"n": F.lit("x"), "df": F.lit(1), "bucket": F.lit(2), "term": F.lit("t")})
    assert rows_of(divergence.audit(docs, least, top)) == plain(rows, least, top)


def test_blocks_and_row_blocks_of_pairs_change_nothing(spark):
    rows = corpus()
    block = divergence.Block()
    whole = collections.Counter()
    for part in itertools.batched(rows, 9):
        block.add([(l or "", s or "") for _, _, l, s in part], [(t or "").encode() for _, t, _, _ in part])
        block._merge()
    for batch in block.drain():
        for lang, term, source, df, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            assert (lang, term, source) not in whole
            whole[lang, term, source] = (df, n)
    want = collections.defaultdict(lambda: [0, 0])
    for _, t, l, s in rows:
        for w, n in collections.Counter((t or "").encode().translate(divergence.LETTERS).split()).items():
            want[l or "", w.decode(), s or ""][0] += 1
            want[l or "", w.decode(), s or ""][1] += n
    assert whole == {k: tuple(v) for k, v in want.items()}
    header = [("en", ["a", "b", "c"], np.array([40, 7, 0]), 47, 3)]
    counts = [("t", [(0, 9), (1, 7)]), ("u", [(0, 30)]), ("v", [(0, 1)])]
    found = []
    for cells in (1, 1 << 20):
        divergence.CELLS, kept = cells, divergence.CELLS
        of = divergence._Lang(*header[0])
        divergence.CELLS = kept
        sums = collections.Counter()
        for term in counts:
            of.terms.append(term)
            for row in of.flush() if len(of.terms) >= of.most else ():
                sums[row[:4]] += row[4]
        for row in of.end(True):
            sums[row[:4]] += row[4]
        found.append(sums)
    assert found[0] == found[1] and len(found[0]) > 3


def test_shares_are_exact_beyond_a_product_of_64_bits():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 2**52, 2000)
    n = (total * rng.random(2000)).astype(np.int64)
    got = divergence.shares(n, total, 12345)
    assert got.tolist() == [1 + 10**9 * (int(a) + 5) // (int(b) + 5 * 12345) for a, b in zip(n, total)]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], D)).collect() == []
