import os
import tempfile

import pytest

from freightlens.config import COLUMN_MAP, DICTIONARY_SCHEMA
from freightlens.session import ensure_checkpoint_dir, is_local
from freightlens.sources.shipments import coerce_types, load_shipments, read_dictionary, read_shipments


def test_sheet_columns_go_by_header(spark):
    folder = tempfile.mkdtemp(prefix="fl-src-")
    with open(os.path.join(folder, "sheet.csv"), "w") as f:
        f.write("Extra,Vehicle Registration,Booking ID\nx,R1,B1\n")
    out = load_shipments(read_shipments(spark, folder))
    row = out.first()
    assert (row.booking_id, row.vehicle_registration, row.Extra) == ("B1", "R1", "x")
    names = {n for n in COLUMN_MAP.values()}
    assert names <= set(out.columns) and row.supplier_name is None
    with open(os.path.join(tempfile.mkdtemp(prefix="fl-src-"), "d.csv"), "w") as f:
        f.write("description,field\nan id,booking_id\n")
    fields = [x.name for x in DICTIONARY_SCHEMA]
    got = read_dictionary(spark, f.name)
    assert got.columns[: len(fields)] == fields


def test_not_a_number_and_infinity_are_missing(spark):
    raw = spark.createDataFrame([("nan",), ("Infinity",), ("-inf",), ("3.5",)], "`Transportation Distance (KM)` string")
    assert [r[0] for r in load_shipments(raw).collect()] == [None, None, None, 3.5]
    typed = spark.createDataFrame([(float("nan"),), (2.0,)], "distance_km double")
    assert [r[0] for r in coerce_types(typed).collect()] == [None, 2.0]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[1,1,1]")


def test_text_sheet_coercion_bad_values_become_null(spark):
    rows = [("B1", "2024-01-02 03:04:05", "12.5", "x"), ("B2", "not a date", "abc", None)]
    raw = spark.createDataFrame(rows, "`Booking ID` string, `Booking Date` string, "
                                      "`Transportation Distance (KM)` string, Extra string")
    out = load_shipments(raw).orderBy("booking_id").collect()
    assert out[0].booking_date is not None and out[0].distance_km == 12.5 and out[0].Extra == "x"
    assert out[1].booking_date is None and out[1].distance_km is None
    assert coerce_types(spark.range(1)).columns == ["id"]
