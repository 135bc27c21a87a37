"""The near-copy stage: SimHash and BK-trees first, the exact similarity decides, what they miss is completed."""

from metaweave.llm import simhash
from metaweave.llm.common import with_locator


def texts():
    """A long text with its last word changed (fingerprints within 2 bits), a pair of similar shorter texts
    further apart, and a text of its own."""
    long = [f"w{i}" for i in range(3000)]
    changed = [*long[:-1], "other"]
    short = [f"s{i}" for i in range(60)]
    near = [*short[:57], "a", "b", "c"]
    return [" ".join(x) for x in (long, changed, short, near, [f"z{i}" for i in range(50)])]


def test_simhash_links_come_first_and_are_not_compared_again(spark, monkeypatch):
    given = texts()
    a, b, c, d, _ = (simhash.fingerprint(x.encode()) for x in given)
    assert (a ^ b).bit_count() <= simhash.RADIUS < (c ^ d).bit_count()
    compared, real = [], simhash.similar_pairs

    def similar_pairs(pairs, *rest):
        compared.append({(r.u, r.v) for r in pairs.collect()})
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "similar_pairs", similar_pairs)
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string")
    _, links = simhash.similar_links(with_locator(docs))
    node = [simhash.shingle_set(x.encode())[0] for x in given]
    pair = lambda i, j: tuple(sorted(n - (1 << 64) if n >= 1 << 63 else n for n in (node[i], node[j])))
    assert [{tuple(sorted(p)) for p in x} for x in compared] == [{pair(0, 1)}, {pair(2, 3)}]
    assert {tuple(sorted((r.u, r.v))) for r in links.collect()} == {pair(0, 1), pair(2, 3)}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {0, 2, 4}


def test_fingerprints_alone_link_nothing(spark):
    """Texts without a shingle of five words in common, but of one fingerprint: the exact check keeps both."""
    docs = spark.createDataFrame([(0, "a a a"), (1, "a a a a a"), (2, "")], "doc_id bigint, text string")
    assert simhash.fingerprint(b"a a a") == simhash.fingerprint(b"a a a a a")
    assert simhash.one_of_each(docs).count() == 3
