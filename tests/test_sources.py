"""Sources, the byte store, the fetch policy, the model stage, migrations and views."""

import pytest
from pyspark.sql import functions as F

from docketry.plans import migrations, views
from docketry.sources import documents as src
from tests.conftest import DATA


def test_json_documents(spark, tmp_path):
    for name, body in {"b.canonical.json": '{"id": 2}', "a.canonical.json": "{", "c.txt": "{}"}.items():
        (tmp_path / name).write_text(body)
    rows = src.json_documents(spark, str(tmp_path), ".canonical.json").orderBy("file").select("file", F.expr("try_variant_get(parsed, '$.id', 'int')").alias("id")).collect()
    assert [tuple(r) for r in rows] == [("a.canonical.json", None), ("b.canonical.json", 2)]


def test_bytes_are_put_once(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"one"),), (bytearray(b"two"),)], "content binary")
    for _ in range(2):
        ids = [r.content_id for r in src.put_bytes(store, rows).collect()]
    assert src.stored_bytes(spark, store).count() == 2
    assert bytes(src.get_bytes(spark, store, ids[0]).first().content) in (b"one", b"two")
    assert src.get_bytes(spark, store, "sha256:../..").count() == 0
    assert src.get_bytes(spark, str(tmp_path / "none"), ids[0]).count() == 0


@pytest.mark.parametrize(
    ("hops", "located", "kind", "size", "seconds", "code"),
    [
        (0, True, "text/html; charset=utf-8", 10, 0.1, "OK"), (6, True, "text/html", 10, 0.1, "REDIRECT_LIMIT"), (1, False, "text/html", 10, 0.1, "REDIRECT_INVALID"),
        (0, True, None, 10, 0.1, "CONTENT_TYPE_NOT_ALLOWED"), (0, True, "image/png", 10, 0.1, "CONTENT_TYPE_NOT_ALLOWED"), (0, True, "text/html", 6 << 20, 0.1, "SIZE_LIMIT"), (0, True, "text/html", 10, 11.0, "TIME_LIMIT"),
    ],
)
def test_fetch_policy(spark, hops, located, kind, size, seconds, code):
    row = spark.createDataFrame([(hops, located, kind, size, seconds)], "h int, l boolean, k string, s long, t double")
    assert row.select(src.FetchPolicy().code(*[F.col(c) for c in "hlkst"]).alias("x")).first().x == code


def test_model_stage_repairs_once_and_fails_closed(spark):
    def transport(prompt):
        if "boom" in prompt:
            raise OSError("down")
        return "good" if "refused" in prompt or "easy" in prompt else "bad"

    rows = spark.createDataFrame([(1, "easy"), (2, "hard"), (3, "boom")], "id int, prompt string")
    got = {r.id: (r.reply, r.calls) for r in src.model_stage(rows, "id", "prompt", transport, lambda x: None if x == "good" else "not good").collect()}
    assert got == {1: ("good", 1), 2: ("good", 2), 3: (None, 2)}


def test_migrations_and_views(spark):
    assert migrations.plan_migrations(spark, [("0002", "nope2"), ("0001", "nope1")]) == ["0001", "0002"]
    views.register(spark, DATA)
    assert migrations.plan_migrations(spark, [("0001", "versions"), ("0002", "nope")]) == ["0002"]
    with pytest.raises(ValueError):
        migrations.plan_migrations(spark, [("0001", "nope"), ("0002", "versions")])
    assert spark.sql("SELECT max(version) AS m FROM versions").first().m > 1
