"""Sheet sets of trees and of the longest chain, without a level for each link."""

import random

from docengine.operators import sheets


def test_sheet_sets_of_trees(spark):
    rnd = random.Random(3)
    before = {i: (rnd.choice([i - 1, rnd.randrange(i), None]) if i else None) for i in range(300)} | {400: 999, 401: 402, 402: 401, 403: 402}
    own = [(i, rnd.randrange(3)) for i in before for _ in range(rnd.randrange(3) if i % 20 == 0 else 1)]
    gone = [(i, rnd.randrange(3)) for i in before if rnd.random() < 0.15]
    sets = {}

    def of(i, depth=0):
        """(sheets, depth) or None."""
        if i not in before or depth > 320:
            return None
        if i not in sets:
            mine, p = [(la, i) for o, la in own if o == i], before[i]
            past = ([], -1) if p is None else of(p, depth + 1)
            if past is None or not mine or past[1] + 1 > 7:
                sets[i] = None
            else:
                lost = {la for o, la in gone if o == i} if p is not None else set()
                sets[i] = None if lost - {la for la, _ in past[0]} else ([x for x in past[0] if x[0] not in lost] + mine, past[1] + 1)
        return sets[i]

    want = sorted((i, *x) for i in before if (s := of(i)) for x in s[0])
    links = spark.createDataFrame(list(before.items()), "id long, predecessor_id long")
    frames = [spark.createDataFrame(x, "revision_id long, label long") for x in (own, gone)]
    spark.sparkContext.setJobGroup("sheets", "sheets")
    got = sorted(map(tuple, sheets.sheet_sets(*frames, links, 8).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sheets"))
    spark.sparkContext.setJobGroup("", "")
    assert got == want
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(32)], "id long, predecessor_id long")
    one = spark.createDataFrame([(i, i) for i in range(32)], "revision_id long, label long")
    spark.sparkContext.setJobGroup("long", "long")
    assert sheets.sheet_sets(one, one.limit(0), chain, 32).count() == 32 * 33 // 2
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("long")) < jobs + 40  # two more rounds, not 24 more levels
    spark.sparkContext.setJobGroup("", "")
