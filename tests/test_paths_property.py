"""Path parsing against a direct model of the reference's rules on random
object names (hypothesis)."""

from hypothesis import given, settings, strategies as st

from shelfmark.functions import paths

ALPHABET = st.sampled_from(list("ab/._-\\E:Q$(") )
NAMES = st.text(alphabet=ALPHABET, min_size=0, max_size=12)


def model(path):
    if path == "":
        return None, None
    ds = "/" if path.startswith("/") else path.split("/")[0]
    rest = path
    while rest.startswith(ds + "/"):
        rest = rest[len(ds) + 1:]
    return ds, (None if rest in (ds, "dd.json") else rest)


@settings(max_examples=4, deadline=None)
@given(st.lists(NAMES, min_size=50, max_size=200))
def test_paths_match_model(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = df.select("p", paths.dataset_of("p").alias("d"), paths.partition_of("p").alias("q")).collect()
    for r in got:
        assert (r.d, r.q) == model(r.p), r.p
