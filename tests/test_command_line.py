import json

from cartolith.__main__ import main


def test_verbs(spark, tmp_path, capsys):
    src, dst = tmp_path / "a.csv", tmp_path / "b.geojson"
    src.write_text("name,wkt\nx,POINT(1 2)\ny,POINT(3 4)\n")
    assert main(["convert", str(src), str(dst), "--src-crs", "EPSG:4326", "--where", "name = 'y'"], spark) == 0
    assert [f["properties"]["name"] for f in json.loads(dst.read_text())["features"]] == ["y"]
    assert main(["convert", str(src), str(dst)], spark) == 1 and "exists" in capsys.readouterr().err
    assert main(["convert", str(src), str(tmp_path / "c.gpkg"), "--src-crs", "EPSG:4326", "--reproject", "EPSG:3857"], spark) == 0
    assert main(["info", str(tmp_path / "c.gpkg")], spark) == 0 and "crs: EPSG:3857" in capsys.readouterr().out
    assert main(["schema", str(tmp_path / "c.gpkg"), "--pretty"], spark) == 0 and json.loads(capsys.readouterr().out)["driver"] == "gpkg"
    assert main(["schema", str(src), "--format", "text"], spark) == 0 and "0 name: string" in capsys.readouterr().out
    assert main(["drivers", "--format", "json"], spark) == 0 and len(json.loads(capsys.readouterr().out)) == 9
    assert main(["convert", str(src), str(tmp_path / "d.gpkg"), "--query", "SELECT 1", "--where", "1=1"], spark) == 1
    assert main(["convert", str(src), str(tmp_path / "d.csv"), "--insert-mode", "bulk"], spark) == 1
    assert main(["convert", str(src), str(tmp_path / "noext"), "--src-crs", "Epsg:1"], spark) == 1
