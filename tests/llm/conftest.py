import random

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu") for b in ("ran", "sel", "dor") for c in ("a", "eth", "on", "is", "ul")]


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls, empties, a long text, ties and repeated rows."""
    r = random.Random(4)
    words = lambda n: [r.choice(WORDS) for _ in range(n)]
    base = words(120)
    out = []
    for i in range(40):
        out.append((i, " ".join(words(r.randint(3, 300))), f"s{i % 3}"))
    for i in range(40, 60):
        near = list(base)
        for _ in range(i % 4):
            near[r.randrange(len(near))] = "edit"
        out.append((i, " ".join(near), "s0"))
    out += [(60, out[3][1].replace(" ", " \n\t "), "s1"), (61, out[3][1], None), (62, None, "s1"), (63, "", None), (64, "   ", "s2"), (65, "One", "s2")]
    out += [(66, "Größe naïve  日本語 <|endoftext|> x\n\n y", "s2"), (67, " ".join(words(9000)), "s9"), (67, out[5][1], "s9"), (68, "tie tie", "s1"), (68, "tie tie", "s1")]
    out += [(None, "no id here at all", "s1"), (None, None, None), (69, out[7][1].upper(), "S")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = {c: F.lit("clash") for c in ("size", "n", "sig", "digest", "key", "node", "hash", "body", "unit", "keys", "leaf", "group", "low", "taken", "lang")}
    return df.withColumns(clash).withColumn("n_chars", F.length("text").cast("long")).repartition(3)
