import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="rankfold-tests-", dir="/tmp")
    s = (SparkSession.builder.master("local[4]").appName("rankfold-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.executorEnv.OMP_NUM_THREADS", "1")
         .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="rankfold-t-", dir="/tmp")


# own rows: two item types, likes, a view, ratings and a purchase of three users
FIX_ITEMS = [
    ("mv_11", "Glass Harbor", "movie", "A slow western about two rivers",
     '{"genre":"Western","year":1971}', '{"director":"I. Varga"}'),
    ("mv_12", "Night Ferry", "movie", "A slow mystery about ferries",
     '{"genre":"Western","year":1988}', '{"director":"L. Okoro"}'),
    ("mv_13", "Copper Lane", "movie", "A loud heist western",
     '{"genre":"Heist","year":2003}', '{"director":"L. Okoro"}'),
    ("bk_21", "Salt Road", "book", "A slow saga about caravans",
     '{"genre":"Saga","year":1952}', '{"author":"M. Sato"}'),
    ("bk_22", "Quiet Mill", "book", "A village novel about clocks",
     '{"genre":"Saga","year":1960}', '{"author":"P. Lindqvist"}'),
]
FIX_INTERACTIONS = [
    (0, "user_1", "mv_11", "like", None),
    (1, "user_1", "mv_12", "like", None),
    (2, "user_1", "bk_21", "rating", 9.0),
    (3, "user_2", "mv_13", "like", None),
    (4, "user_2", "mv_11", "view", None),
    (5, "user_3", "mv_11", "rating", 8.0),
    (6, "user_3", "bk_22", "purchase", None),
]
ITEM_SCHEMA = "item_id string, title string, item_type string, description string, features string, metadata string"
INTER_SCHEMA = "seq long, user_id string, item_id string, interaction_type string, value double"


@pytest.fixture()
def fix_items(spark):
    from pyspark.sql import functions as F
    return spark.createDataFrame(FIX_ITEMS, ITEM_SCHEMA).withColumn(
        "created_at", F.timestamp_seconds(F.lit(1704067200)).cast("timestamp_ntz"))


@pytest.fixture()
def fix_interactions(spark):
    return spark.createDataFrame(FIX_INTERACTIONS, INTER_SCHEMA)
