"""Pairs of shapes: only those that cross are compared edge by edge."""

from helpers import rectangle
from rooftally.operators import box_join as B
from rooftally.operators import shape_join

SHAPE = "id int, geometry array<array<array<array<double>>>>"


def blocks(spark):
    """A block with a courtyard, a plain one, and one without any extent."""
    return spark.createDataFrame([(1, [[rectangle(0.0, 0.0, 8.0, 8.0), rectangle(2.0, 2.0, 4.0, 4.0)]]), (2, [[rectangle(16.0, 0.0, 4.0, 4.0)]]),
                                  (3, [[rectangle(17.0, 1.0, 0.0, 0.0)]])], SHAPE)


def lots(spark):
    """Inside, in the courtyard, across an edge, touching a corner, around a block, the block's own outline, far away."""
    boxes = [(0.5, 0.5, 1.0), (3.0, 3.0, 1.0), (1.5, 3.0, 1.0), (20.0, 4.0, 1.0), (15.0, -1.0, 8.0), (16.0, 0.0, 4.0), (40.0, 0.0, 1.0), (2.0, 3.0, 1.0)]
    return spark.createDataFrame([(k, [[rectangle(x, y, s, s)]]) for k, (x, y, s) in enumerate(boxes)], SHAPE)


WANTED = {(1, 0): 1.0, (1, 2): 0.5, (1, 7): 0.0, (2, 3): 0.0, (2, 4): 16.0, (2, 5): 16.0, (3, 4): 0.0, (3, 5): 0.0}


def test_pairs_by_hand_from_either_side(spark):
    a, b = blocks(spark).withColumnRenamed("id", "a"), lots(spark).withColumnRenamed("id", "b")
    assert {(r.a, r.b): r.shared_deg2 for r in shape_join.shape_pairs(a, b, "a", "b").collect()} == WANTED
    assert {(r.a, r.b): r.shared_deg2 for r in shape_join.shape_pairs(b, a, "b", "a").collect()} == WANTED


def test_edges_are_compared_for_crossed_pairs_only(spark):
    a, b = blocks(spark).withColumnRenamed("id", "a"), lots(spark).withColumnRenamed("id", "b")
    pairs = B.box_pairs(shape_join._shaped(a, "geometry", "a"), shape_join._shaped(b, "geometry", "b"))
    placed = {(r.a, r.b): (r._state, r._edges_l is not None) for r in shape_join._placed(pairs, "a", "b").collect()}
    assert placed[1, 0] == ("r", False) and placed[2, 4] == ("l", False) and placed[1, 2] == ("crossed", True) and (1, 1) not in placed


def test_a_box_is_not_sent_to_a_level_without_partners(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "id int, minx double, miny double, maxx double, maxy double")
    assert B._registered(a, "l", [5, 6]).select("_level").distinct().count() == 2 and B._registered(a, "l", []).count() == 0
