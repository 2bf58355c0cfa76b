"""The search for trades ends only when no pair of bins has one."""

from basketry.llm import packing


def test_trades_among_the_fullest_of_many_bins():
    bins = {(2049 + i,): 1 for i in range(700)} | {(3000, 10): 1, (3000, 1086): 1}
    out = packing.local_search(bins, 4096)
    assert out[(3000, 1086, 10)] == 1 and out[(3000,)] == 1 and len(out) == len(bins)
    under = [b for b in out if sum(b) < 4096]
    assert all(packing._trade(a, b, 4096) is None for a in under[-30:] for b in under if a != b)
