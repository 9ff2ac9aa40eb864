"""Every registered query against its SQL, and the whole curation against pandas."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from rowloom.plans.curate import curate


@pytest.fixture(scope="session")
def engine(sf):
    connection = duckdb.connect()
    for name in os.listdir(sf):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return connection


def comparable(values):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in values)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sf, engine, name):
    result = contract.queries()[name](spark, sf)
    columns = sorted(result.columns)
    found = result.select(*[F.col(f"`{c}`") for c in columns]).collect()
    if name not in contract.oracle_sql():
        assert found
        return
    cursor = engine.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    assert comparable(found) == comparable(wanted)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_curation_matches_pandas(spark):
    """The steps one by one on plain frames, with gaps, equal keys and rare labels."""
    names, structures = [], []
    for i in range(60):
        entity = f"D{i:02d}"
        for k in range(1 + i % 3):
            names.append((entity, f"Cytochrome P450 {(i * 7 + k) % 5}A{k}, long", len(names)))
        names.append((entity, "Albumin", len(names)))
        if i % 11:
            key = None if i % 4 == 0 else f"K{i % 37}"
            structures.append((entity, f"N{i}", key, None if i % 8 == 0 else f"S{i}", len(structures)))
    types = [(f"D{i:02d}", "small" if i % 5 else "large") for i in range(60)]
    dictionary = [(f"N{i}", j, f"M{i}", f"F{i}.{j}" if (i + j) % 3 else None, j != 1) for i in range(0, 60, 4) for j in range(i % 3)]
    to_key = lambda value: "K" + value if not value.endswith("0") else None

    n = pd.DataFrame(names, columns=["entity", "name", "pos"])
    n["code"] = [x.split()[2].strip(",") if "Cytochrome P450" in x else None for x in n["name"]]
    grouped = n.dropna(subset=["code"]).groupby("entity", sort=False)["code"].agg(lambda c: ["CYP" + x for x in c]).reset_index()
    s = pd.DataFrame(structures, columns=["entity", "name", "key", "value", "pos"]).drop(columns="pos")
    joined = grouped.merge(s, on="entity", how="left")
    small = joined[joined["entity"].isin([e for e, t in types if t == "small"])]
    extra = []
    for row in small[small["key"].isnull()].itertuples():
        for name, _, matched, value, found in dictionary:
            if name == row.name and found:
                extra.append((row.entity, row.code, matched, to_key(value) if value else None, value))
    both = pd.concat([small, pd.DataFrame(extra, columns=["entity", "code", "name", "key", "value"])], ignore_index=True)
    clean = both.dropna(subset=["value"])
    drop = clean[clean.duplicated(subset=["key"], keep="first")]["entity"]
    clean = clean[~clean["entity"].isin(drop)]
    clean = clean[clean["entity"] != "D03"]
    counts = clean["code"].explode().value_counts()
    kept = set(counts[counts >= 4].index)
    want = sorted((r.entity, r.name, str(r.value), [c for c in r.code if c in kept]) for r in clean.itertuples())

    made = curate(
        spark.createDataFrame(names, "entity string, name string, pos bigint").repartition(3),
        spark.createDataFrame(structures, "entity string, name string, key string, value string, pos bigint").repartition(2),
        spark.createDataFrame(types, "entity string, type string"),
        spark.createDataFrame(dictionary, "name string, order bigint, matched_name string, matched_value string, found boolean"),
        wanted_type="small", to_key=to_key, excluded="D03", threshold=4,
    )
    got = sorted((r["entity"], r["name"], r["value"], list(r["labels"])) for r in made.table.collect())
    assert got == want and len(want) > 5
    assert {r["label"]: r["n"] for r in made.counts_before.collect()} == counts.to_dict()
    assert {r["label"] for r in made.counts_after.collect()} == kept
