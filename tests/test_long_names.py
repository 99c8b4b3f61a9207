"""Long names whose common part is moved by more than three characters still meet."""

from graphloom.operators import entities


def test_four_characters_moved_in_a_long_name(spark):
    name = "".join(chr(0x4E00 + i) for i in range(70))
    pair = [name, name[4:] + name[:4]]
    got = entities.similar_names(spark.createDataFrame([("P", n) for n in pair], "entity_class string, name string")).collect()
    assert [(r["a"], r["b"]) for r in got] == [tuple(sorted(pair))]
