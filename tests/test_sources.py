"""Scans of files in old and new layouts, and the live path."""

from __future__ import annotations

import json

import numpy as np

from ethospark.sinks import files
from ethospark.sources import tracks
from ethospark.streaming import live


def test_track_files(spark, tmp_path):
    day = tmp_path / "tracks" / "cam1" / "2025-01-31"
    day.mkdir(parents=True)
    (day / "T180000_ID000007.csv").write_text("frame_id,timestamp,bbox_top2,bbox_left2,bbox_bottom2,bbox_right2,score,world_x,world_y\n1,2025-01-31 18:00:00.250,0.1,0.2,0.3,0.4,0.9,1.5,2.5\n2,not a time,0,0,0,0,0,0,0\n")
    (day / "T190000_ID000008.csv").write_text("timestamp,bbox_top,bbox_left,bbox_bottom,bbox_right,score\n2025-01-31 19:00:00,1,2,3,4,0.5\n")
    (day / "T190000_ID000008_behavior.csv").write_text("timestamp,behavior_label_raw,behavior_label,behavior_conf\n2025-01-31 19:00:00,01_standing,02_sleeping_left,0.8\n2025-01-31 19:00:01,,02_sleeping_left,x\n")
    (day / "part_1.csv").write_text("timestamp\n2025-01-31 19:00:00\n")
    found = {r["track"]: r for r in tracks.tracks(spark, str(tmp_path / "tracks")).collect()}
    assert sorted(found) == [7, 8] and found[7]["world_x"] == 1.5 and found[8]["bbox_top"] == 1.0 and found[8]["world_x"] is None
    assert str(found[7]["date"]) == "2025-01-31" and found[7]["camera"] == "cam1" and found[7]["file_time"].hour == 18
    assert tracks.for_night(tracks.tracks(spark, str(tmp_path / "tracks")), "2025-01-30").count() == 2
    labels = lambda order: [r["label"] for r in tracks.behaviours(spark, str(tmp_path / "tracks"), order).orderBy("ts").collect()]
    assert labels(tracks.AS_PREDICTED) == ["01_standing", "02_sleeping_left"]
    assert labels(tracks.AS_CORRECTED) == ["02_sleeping_left"] * 2


def test_tracking_lines(spark, tmp_path):
    lines = [{"meta": {"video": "v", "fps": 25.0, "width": 10, "height": 5}}, {"results": {"frame_idx": 3, "timestamp": "t", "tracks": [{"raw_track_id": "a", "bbox": [1, 2, 3, 4], "score": 0.5}, {"raw_track_id": "b", "bbox": [], "score": 0.1}]}}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = tracks.tracking_lines(spark, str(tmp_path / "x.jsonl")).orderBy("raw_track_id").collect()
    assert [(r["raw_track_id"], r["fps"], r["frame_idx"]) for r in got] == [("a", 25.0, 3), ("b", 25.0, 3)]


def test_tracklets_fall_back(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"track_id": "1", "identity_label": "unknown", "voted_track_label": "Ann"}, {"track_id": "2", "identity_label": "Bo"}, {"track_id": "3"}]))
    assert [r["identity"] for r in tracks.tracklets(spark, str(tmp_path / "t.json")).orderBy("track_id").collect()] == ["Ann", "Bo", "unknown"]


def test_embedding_files(spark, tmp_path):
    np.savez(tmp_path / "a.npz", features=np.eye(2, 3, dtype="float32"), frame_ids=np.array([5, 9]))
    got = tracks.embeddings(spark, str(tmp_path)).orderBy("frame_id").collect()
    assert [(r["frame_id"], list(r["feature"])) for r in got] == [(5, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0])]


def test_video_index(spark, tmp_path):
    (tmp_path / "db.json").write_text(json.dumps({"cameras": {"c1": {"videos": ["a", "b"], "start_times": ["2025-01-01 00:00:00", "2025-01-01 01:00:00"], "end_times": ["2025-01-01 01:00:00", "2025-01-01 02:00:00"]}}}))
    known = tracks.video_index(spark, str(tmp_path / "db.json"))
    assert known.count() == 2
    listed = known.where("video = 'a'").unionByName(known.where("video = 'b'").selectExpr("camera", "'c' as video", "start", "end"))
    assert sorted(r["video"] for r in tracks.refresh_index(known, listed).collect()) == ["a", "c"]
    names = spark.createDataFrame([("cam3_20250102_030405.mp4", 60.0), ("junk.mp4", 1.0)], "name string, seconds double")
    got = tracks.video_times(names, "name", "seconds").orderBy("name").collect()
    assert (got[0]["camera"], str(got[0]["start"]), str(got[0]["end"])) == ("cam3", "2025-01-02 03:04:05", "2025-01-02 03:05:05") and got[1]["start"] is None


def test_batches_are_written_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.detections(spark, str(tmp_path / "in"), "id long, v string")
    for _ in range(2):  # the second run finds nothing new
        live.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["id"])
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_csv_with_quotes_and_short_lines(spark, tmp_path):
    for date in ("2025-01-30", "2025-01-31", "2025-02-03"):
        day = tmp_path / "cam1" / date
        day.mkdir(parents=True)
        (day / "T180000_ID000007.csv").write_text(f'timestamp,identity_label,score\n{date} 18:00:00,"Ann, the timestamp",0.5\n{date} 18:00:01,Bo\n')
    (day / "T180000_ID7.csv").write_text("timestamp\n2025-02-03 18:00:00\n")
    got = tracks.tracks(spark, tracks.night_paths(str(tmp_path), "2025-01-30")).orderBy("ts").collect()
    assert [(str(r["date"]), r["identity_label"], r["score"], r["corrupt"] is None) for r in got] == [("2025-01-30", "Ann, the timestamp", 0.5, True), ("2025-01-30", "Bo", None, False), ("2025-01-31", "Ann, the timestamp", 0.5, True), ("2025-01-31", "Bo", None, False)]
    all_ = tracks.tracks(spark, str(tmp_path))
    assert all_.count() == 7 and tracks.strict_names(all_).count() == 6
    assert tracks.between(all_, "2025-01-31 00:00:00", "2025-02-01 00:00:00").count() == 2
    assert tracks.positions(all_).count() == 0


def test_listings_and_summaries(spark, tmp_path):
    for name in ("b.MP4", "A.mp4", "x.txt", "c_skip.avi"):
        (tmp_path / name).write_bytes(b"123")
    got = tracks.video_files(spark, str(tmp_path), ["mp4", ".avi"]).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in got] == ["A.mp4", "b.MP4", "c_skip.avi"] and got[0]["length"] == 3
    assert tracks.video_files(spark, str(tmp_path), ["avi"], "SKIP").count() == 1
    import datetime

    assert tracks.scan_targets(["/v/%Y/%m", "/v/%Y/%m", "/w/*"], datetime.datetime(2025, 3, 1)) == ["/v/2025/03", "/w/*"]
    for group in ("anna", "bo"):
        (tmp_path / f"2025-01-01_{group}_bouts.csv").write_text("start_time,behavior_label\n1,rest\n")
    rows = tracks.bout_summaries(spark, str(tmp_path), "bouts").collect()
    assert sorted((r["group"], r["companions"]) for r in rows) == [("anna", "bo"), ("bo", "anna")]
    made = tracks.synthetic_nights(spark, 3, 4, 1)
    assert made.count() == 12 and made.where("end_us <= start_us").count() == 0 and made.exceptAll(tracks.synthetic_nights(spark, 3, 4, 1)).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c1", 7, 1, 0.5, "2025-01-01"), ("c1", 7, 0, 0.25, "2025-01-01"), ("c2", 8, 0, 1.0, "2025-01-02")], "camera string, track int, us long, score double, night string")
    files.track_csv(df, str(tmp_path / "t"), ["camera", "track"], ["us"])
    assert [r["us"] for r in spark.read.option("header", True).csv(str(tmp_path / "t" / "camera=c1" / "track=7")).collect()] == ["0", "1"]
    files.night_csv(df, str(tmp_path / "n"), "night", ["camera", "score"])
    files.night_csv(df.where("camera = 'c2'").withColumn("score", df["score"] + 1), str(tmp_path / "n"), "night", ["camera", "score"])
    back = spark.read.option("header", True).csv(str(tmp_path / "n"))
    assert back.count() == 3 and back.where("night = '2025-01-02'").first()["score"] == "2.0"
    for _ in range(2):
        files.append_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 6
    files.tracklet_json(spark.createDataFrame([("f1", None)], "track_filename string, identity_label string"), str(tmp_path / "j"))
    old = spark.read.schema("track_filename string, identity_label string").json(str(tmp_path / "j"))
    assert files.with_identities(old, spark.createDataFrame([("f1", "Ann")], "track_filename string, identity string")).first()["identity_label"] == "Ann"
    files.embeddings(df.selectExpr("camera", "night", "array(cast(score as float)) as feature"), str(tmp_path / "e"), ["camera", "night"])
    assert spark.read.parquet(str(tmp_path / "e")).count() == 3
    files.count_log(df.selectExpr("camera", "us as start_us", "1000000L as duration_us", "cast(track as long) as count"), str(tmp_path / "l"), ["camera"])
    assert {(r["duration_s"], r["track_count"]) for r in spark.read.option("header", True).csv(str(tmp_path / "l")).collect()} == {("1.0", "7"), ("1.0", "8")}
    files.grouped_export(df, str(tmp_path / "g"), "camera", "night")
    assert (tmp_path / "g" / "camera=c2" / "night=2025-01-02").is_dir()


def test_live_changes_closing_and_replay(spark, tmp_path):
    target = spark.createDataFrame([(1, 5, "x", True), (2, 5, "y", True)], "track int, end_us long, identity string, open boolean")
    closed = spark.createDataFrame([(1, 9, "z"), (1, 8, "w")], "track int, end_us long, identity string")
    assert sorted(map(tuple, live.close_tracks(target, closed, ["track"]).collect())) == [(1, 9, "z", False), (2, 5, "y", True)]
    frames = spark.sql("SELECT camera, timestamp_micros(cast(s as bigint) * 1000000) AS t FROM VALUES ('a', 0), ('a', 10), ('b', 20), ('a', 500), ('b', 86400), ('b', 86410) AS v(camera, s)")
    out = live.replay_order(frames, "t", 1, ["camera"], "60 seconds").orderBy("replay_us").collect()
    assert [r["replay_us"] // 1_000_000 for r in out] == [0, 10, 20, 80, 140, 150]
    assert live.replay_order(frames, "t", 2, ["camera"]).count() == 4
    again = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (1, "2025-01-01 00:00:01"), (2, "2025-01-01 00:00:02")], "id int, t string").selectExpr("id", "cast(t as timestamp) as t")
    again.coalesce(1).write.parquet(str(tmp_path / "in2"))
    unique = live.once(live.detections(spark, str(tmp_path / "in2"), "id int, t timestamp"), "t", ["id"], "10 minutes")
    assert sorted(r["id"] for r in live.drain(unique, str(tmp_path / "out2"), "append").collect()) == [1, 2]
    assert live.speed({"processedRowsPerSecond": 3}) == 3.0 and live.speed({}) == 0.0


def book(path, sheets, strings=(), date_1904=False):
    """A workbook written by hand: sheets by name, rows as XML of cells."""
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="{int(date_1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="x" Target="{"/xl/" if k == 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="dd\\.mm\\.yyyy"/><numFmt numFmtId="165" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')


def test_workbook_reads_like_its_csv(spark, tmp_path):
    from pyspark.sql import functions as F

    from ethospark.sources import workbook

    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>n</t></is></c></row>'
        '<row r="2"><c r="A2" s="1"><v>45660</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>1.5</v></c><c r="D2" s="3"><v>7</v></c></row>'
        '<row r="3"><c r="B3" t="str"><v>Bo &amp; Cy</v></c></row><row r="4"/>'
        '<row r="5"><c r="A5" t="inlineStr"><is><t>6.1.2025</t></is></c><c r="B5" t="b"><v>1</v></c></row>'
        '<row r="6"><c r="A6" s="2"><v>45664.75</v></c><c r="D6" t="e"><v>#N/A</v></c></row>'
    )
    strings = ["<t>date</t>", "<t>where</t>", '<r><t>Ann </t></r><r><t xml:space="preserve"> in</t></r><rPh><t>hint</t></rPh>']
    book(tmp_path / "log.xlsx", {"log": rows, "other": '<row><c><v>1</v></c></row><row><c s="1"><v>0.5</v></c></row>'}, strings)
    (tmp_path / "log.csv").write_text("date,where,column 3,n\n2025-01-03,Ann  in,1.5,7\n,Bo & Cy,,\n6.1.2025,TRUE,,\n2025-01-07 18:00:00,,,#N/A\n")
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    got = workbook.sheets(spark, str(tmp_path))
    csv = [{k: v for k, v in r.asDict().items() if v is not None} for r in spark.read.option("header", True).csv(str(tmp_path / "log.csv")).collect()]
    assert [r["cells"] for r in got.where("sheet = 'log'").orderBy("row").collect()] == csv
    assert [r["row"] for r in got.where("sheet = 'log'").orderBy("row").collect()] == [2, 3, 5, 6]
    assert [(r["file"].rsplit("/", 1)[1], r["row"]) for r in got.where("corrupt is not null").collect()] == [("bad.xlsx", None)]
    assert [r["cells"] for r in got.where("sheet = 'other'").collect()] == [{"1": "1899-12-31 12:00:00"}]
    assert workbook.sheets(spark, str(tmp_path), "nowhere").where("corrupt is null").count() == 0
    log = workbook.keeper_sheet(spark, str(tmp_path), "date", {"where": "location"}, "log").orderBy("row").collect()
    assert [(str(r["date"]), r["location"]) for r in log] == [("2025-01-03", "Ann  in"), ("2025-01-03", "Bo & Cy"), ("2025-01-06", "TRUE"), ("2025-01-07", "")]
    book(tmp_path / "old.xlsx", {"log": '<row><c t="inlineStr"><is><t>d</t></is></c></row><row><c s="1"><v>1</v></c></row>'}, date_1904=True)
    assert [r["cells"]["d"] for r in workbook.sheets(spark, str(tmp_path / "old.xlsx")).collect()] == ["1904-01-02"]
    texts = ["31/12/2024", " 1-2-2025", "2025-3-4 05:00", "12.31.2024", "x", None]
    dates = spark.createDataFrame([(t,) for t in texts], "t string").select(workbook.day_first(F.col("t")).cast("string").alias("d")).collect()
    assert [r["d"] for r in dates] == ["2024-12-31", "2025-02-01", "2025-03-04", None, None, None]


def test_csv_of_many_columns_and_quoted_names(spark, tmp_path):
    day = tmp_path / "cam1" / "2025-01-30"
    day.mkdir(parents=True)
    wide = [f"x{i}" for i in range(40)]
    (day / "T180000_ID000001.csv").write_text(",".join([*wide, "timestamp", "score"]) + "\n" + ",".join([*"1" * 40, "2025-01-30 18:00:00", "0.5"]) + "\n")
    (day / "T180000_ID000002.csv").write_text('﻿"timestamp", "frame_id","identity_label"\r\n\r\n"2025-01-30 18:00:01",7,"An ""A"", x"\r\n2025-01-30 18:00:02,8," open\r\n')
    (day / "T180000_ID000003.csv").write_text("time,score\n2025-01-30 18:00:03,0.1\n")
    (day / "T180000_ID000004.csv").write_text("")
    (day / "T180000_ID000005.csv").write_text("timestamp,identity_label\n2025-01-30 18:00:04," + "y" * 100_000 + "\n2025-01-30 18:00:05\n")
    got = {str(r["ts"])[-2:]: (r["track"], r["frame_id"], r["score"], r["identity_label"], r["corrupt"] is not None) for r in tracks.tracks(spark, str(tmp_path)).collect()}
    assert got == {"00": (1, None, 0.5, None, False), "01": (2, 7, None, 'An "A", x', False), "02": (2, 8, None, '" open', False), "04": (5, None, None, "y" * 100_000, False), "05": (5, None, None, None, True)}
    assert sorted((r["stem"][-1], r["line"][:4]) for r in tracks.corrupt_lines(spark, str(tmp_path)).collect()) == [("3", "2025"), ("5", "2025")]


def test_files_of_a_time_range_are_listed_by_name(spark, tmp_path):
    for day, clock in (("2025-01-30", "180000"), ("2025-01-30", "235959"), ("2025-01-31", "000000"), ("2025-02-03", "180000")):
        folder = tmp_path / "cam1" / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"T{clock}_ID000001.csv").write_text(f"timestamp,score\n{day} 18:00:00,0.5\n")
    (tmp_path / "cam1" / "2025-01-31" / "empty.csv").write_text("start_time\n")
    got = tracks.paths_between(spark, str(tmp_path), "2025-01-30 20:00:00", "2025-02-01 00:00:00")
    assert [p.rsplit("/", 2)[1:] for p in got] == [["2025-01-30", "T235959_ID000001.csv"], ["2025-01-31", "T000000_ID000001.csv"]]
    every = tracks.between(tracks.tracks(spark, str(tmp_path)), "2025-01-30 20:00:00", "2025-02-01 00:00:00")
    assert tracks.tracks(spark, got).count() == every.count() == 2
    assert tracks.paths_between(spark, str(tmp_path), "2026-01-01 00:00:00", "2026-01-02 00:00:00") == []
