"""The address of an upload, and rows to canonical columns."""

from pyspark.sql import functions as F

from waymark.functions import text, uploads
from waymark.operators import mapping
from waymark.sources import tabular

SUFFIXED = {"Street Number": "37", "Street Number Suffix": "A", "Street Name": "JOHN", "Street Type": "ST", "City": "St. Catharines", "State": "ON", "Postal Code": "L2N4P2"}


def best(spark, meta, raw=None, city=None, state=None, zip_code=None, f=lambda *_: uploads.built_address()):
    row = spark.createDataFrame([(meta, raw, city, state, zip_code)], "meta map<string,string>, raw string, city string, state string, zip string")
    own = uploads.with_parts(row, *map(F.col, row.columns))
    return own.select(f(*map(F.col, row.columns)).alias("x")).first().x


def test_best_address(spark):
    labelled = {"Address Type": "Res", "Street No": "3145", "Street Name": "BELLVUE RD", "City": "TILLAMOOK", "State": "OR", "Zip": "97141"}
    assert best(spark, labelled, "Res") == "3145 BELLVUE RD, TILLAMOOK, OR, 97141"
    assert best(spark, SUFFIXED) == "37A JOHN ST, St. Catharines, ON, L2N4P2"
    assert best(spark, {**SUFFIXED, "Street Number Suffix": "-B"}).startswith("37-B JOHN ST,") and best(spark, {**SUFFIXED, "Street Number Suffix": "1/2"}).startswith("37 1/2 JOHN ST,")
    whole = {**SUFFIXED, "ADDRESS": "9 DOROTHY ST, ST CATHARINES, ON", "Street Number": "9", "Street Name": "DOROTHY"}
    assert best(spark, whole, whole["ADDRESS"]).startswith("9A DOROTHY ST,")
    assert best(spark, {k: v for k, v in whole.items() if k != "Street Number Suffix"}, whole["ADDRESS"]) == whole["ADDRESS"]
    assert best(spark, {**{k: v for k, v in whole.items() if k != "Street Number Suffix"}, "Street Number": "11"}, whole["ADDRESS"]).startswith("11 DOROTHY ST,")
    assert best(spark, {"STREET NUMBER": "49", "street_number_suffix": "A", "Street-Name": "DOROTHY"}) == "49A DOROTHY"
    assert best(spark, {"Street No": "5", "Street Name": "Main St", "Street Type": "st"}) == "5 Main St"
    assert best(spark, {"category": "Com"}, "Com") == "" and best(spark, {}, " 12 Oak St ") == "12 Oak St" and best(spark, {"Address": "77"}, "x") == "x" and best(spark, {"Address": "Old Mill"}, None) == "Old Mill"
    assert best(spark, {"Street No": "5"}, None) == "" and best(spark, {"Street No": "5", "Street Name": "n/a"}, "Res") == ""


def test_labels_and_types(spark):
    rows = spark.createDataFrame([(v,) for v in ("Res", " household ", "COM", "3145 Bellvue Rd", None, "n/a")], "v string").select(uploads.address_type(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == ["residential", "residential", "commercial", "unknown", "unknown", "unknown"]
    f = lambda meta, raw, *_: uploads.annotated(meta, raw)
    got = best(spark, {"Address Type": "Res", "Street No": "3145"}, "Res", f=f)
    assert got == {"Address Type": "Res", "Street No": "3145", "address_type": "Residential", "address_type_code": "Res", "category": "household", "res_com_handled": "true", "address_type_source_value": "Res"}
    assert best(spark, {"type": "business", "category": "mine"}, "1 A St", f=f) == {"type": "business", "category": "mine", "address_type": "Commercial", "address_type_code": "Com", "res_com_handled": "true"}
    assert best(spark, {"a": "b"}, "1 A St", f=f) == {"a": "b"}
    line = lambda *_: uploads.built_street()
    assert best(spark, SUFFIXED, f=line) == "37A JOHN ST" and best(spark, {}, "12 Oak St, Austin, TX", f=line) == "12 Oak St" and best(spark, {}, "Oak", f=line) == ""


def test_resolved_and_keyed(spark):
    f = lambda meta, raw, city, state, zip_code: uploads.best_address(uploads.built_address(), F.lit(None).cast("string"), F.lit("1845 Main Ave N Tillamook OR 97141-9252"), F.lit("Com"))
    assert best(spark, {"Address Type": "Com", "Street No": "1845", "Street Name": "MAIN AVE N"}, "Com", f=f) == "1845 Main Ave N Tillamook OR 97141-9252"
    key = lambda *a: uploads.best_key(uploads.built_address(), a[4])
    one, two = (best(spark, {**SUFFIXED, "Street Number Suffix": s}, None, None, None, "L2N4P2", f=key) for s in "AB")
    assert one == "37A JOHN ST ST CATHARINES ON L2N4P2" and one != two
    assert best(spark, {"Street No": "3145", "Street Name": "BELLVUE RD"}, "Res", None, None, "97141-22", f=key) == "3145 BELLVUE RD 97141 22" and best(spark, {}, "Res", f=key) is None
    up = lambda meta, raw, resolved, *_: uploads.upload_line(raw, meta, resolved, uploads.built_address())
    assert best(spark, {"category": "Households", "placemark_name": "4910 NW 152ND LN"}, "Households: 4910 NW 152ND LN", f=up) == "4910 NW 152ND LN"
    assert best(spark, {"category": "Res"}, "Res", f=up) == "" and best(spark, {}, None, "Old Mill", f=up) == "Old Mill" and best(spark, {"category": "Poles"}, "Poles", f=up) in ("", "Poles")


def test_input_line(spark):
    rows = [("12 Main, Austin", "Austin", "TX", "30301-1234"), ("12 Main, Austin, TX 30301", "Austin", "TX", "30301"), (" 12 Main ", None, "TX", None), ("12 Main", "Austin", None, ""), ("", "A", "B", "1")]
    got = spark.createDataFrame(rows, "a string, c string, s string, z string").select(text.input_line(*map(F.col, "acsz")).alias("x")).collect()
    assert [r.x for r in got] == ["12 Main, Austin, Austin, TX, 30301", "12 Main, Austin, TX 30301", "12 Main, TX", "12 Main, Austin", "A, B, 1"]


def mapped(spark, fields, **kw):
    return mapping.map_records(spark.createDataFrame([(list(fields.items()),)], "f array<struct<key:string,value:string>>").select(F.map_from_entries("f").alias("fields")), **kw).first()


def test_mapped_rows(spark):
    r = mapped(spark, {"Address": "1603 LAFAYETTE ST", "Latitude": "32.086591", "Longitude": "-84.241345", "Terminal ID": "T-1", "Node": "6BA8", "Address ID": "A1098636881"})
    assert (r.raw_address, r.lat, r.lon, r.terminal_id, r.network_node, r.address_id, r.normalized_key) == ("1603 LAFAYETTE ST", 32.086591, -84.241345, "T-1", "6BA8", "A1098636881", "1603 LAFAYETTE ST")
    assert mapped(spark, SUFFIXED).raw_address == "37A JOHN ST, St. Catharines, ON, L2N4P2"
    r = mapped(spark, {"Lat": "33.1", "coordinates": "-84.2,33.0", "win_exchange_id": "AMRC01", "placemark_name": "Pole 7", "address id": "0", "win_lon": " a77 "})
    assert (r.lat, r.lon, r.city, r.state, r.raw_address, r.address_id) == (33.0, -84.2, "Americus", "GA", "Pole 7", "a77")
    r = mapped(spark, {"Lat": "33.1", "Longitude": "-84", "coordinates": "-84.2,33.0", "City": "X", "data_source": "AMRC", "upload_batch_id": "b", "_hidden": "h"})
    assert (r.lat, r.lon, r.city, r.state) == (33.1, -84.0, "X", "GA") and r.uploaded == {"Lat": "33.1", "Longitude": "-84", "coordinates": "-84.2,33.0", "City": "X", "data_source": "AMRC"}
    assert r.old.city_state == "X, GA" and r.old.latitude == 33.1 and r.old.street_number_name == ""
    r = mapped(spark, {"address": "1 A St", "Address ": "2 B St", "City": "P", " city": "n/a", "ns1:State": "ga"}, labels=False)
    assert (r.raw_address, r.city, r.state) == ("2 B St", None, "GA")
    r = mapped(spark, {"Address": "Res", "Street No": "5", "Street Name": "Elm", "noc_plan_desc": "XX ABCDTX"})
    assert (r.raw_address, r.state, r.meta["category"]) == ("5 Elm, TX", "TX", "household") and "category" not in r.uploaded
    r = mapped(spark, {"Address": "5 Elm", "City": "P", "State": "TX"}, labels=False)
    assert r.normalized_key == "5 ELM|P|TX" and mapped(spark, {"Address": "5 Elm", "Zip": "30301", "City": "P", "State": "TX"}, labels=False).normalized_key == "5 ELM|30301"


def test_csv_with_line_breaks_and_a_header_twice(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Address, City ,City,Note\n"1 Oak\nSt, ""rear""",P,Q,x\n,,,\n2 Elm,R,n/a,\n')
    rows = {r.row_number: r.fields for r in tabular.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {2: {"Address": '1 Oak\nSt, "rear"', "City": "Q", "Note": "x"}, 4: {"Address": "2 Elm", "City": None, "Note": None}}
    (tmp_path / "b.csv").write_text("Address\n" + "".join(f"{k} Oak St\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
        split = tabular.read_csv(spark, str(tmp_path / "b.csv"), multi_line=False)
        assert {(r.row_number, r.fields["Address"]) for r in split.collect()} == {(k + 2, f"{k} Oak St") for k in range(5000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.row_number, r.fields["Address"]) for r in tabular.read_csv(spark, str(tmp_path / "b.csv")).collect()} == {(k + 2, f"{k} Oak St") for k in range(5000)}
