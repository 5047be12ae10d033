"""What the copy check moves between tasks."""

from inkspark import queries as library

library.load()


def shuffled(spark):
    """MB that all stages so far have written for others."""
    context, gateway = spark._jsc.sc(), spark.sparkContext._gateway
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) / 1e6


def test_texts_of_scripts_move_once(spark):
    """2.5 MB of text, half of it in scripts: texts of all three levels were joined anew for each look (6.0 MB)."""
    before = shuffled(spark)
    assert len(library.QUERIES["x19_copy_risk"](spark, "/root/testdata/sf0.01").collect()) == 500
    assert 0 < shuffled(spark) - before < 3
