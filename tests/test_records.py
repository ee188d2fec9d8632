import pytest

from tidemark.sources.files import ContractError
from tidemark.sources.records import parse_records


def test_kept_fields_only(spark):
    raw = spark.createDataFrame([('{"id": 1, "at": 1700000000, "version": " 2.1 ", "user_name": "A B"}',), ('{"id": 2, "at": 0, "version": "0"}',), ('{"version": null}',), ("no record",), (None,)], "record string")
    found = [tuple(r) for r in parse_records(raw, {"id": "long", "at": "timestamp", "version": "string"}).selectExpr("id", "unix_seconds(at)", "version").collect()]
    assert found == [(1, 1700000000, "2.1"), (2, None, None), (None, None, None), (None, None, None), (None, None, None)]
    for name in ("user_name", "User-Image", "EMAIL"):
        with pytest.raises(ContractError, match="personal"):
            parse_records(raw, {"id": "long", name: "string"})
