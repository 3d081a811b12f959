import json

import pytest

from folioscope.__main__ import main
from folioscope.sources.files import read_config


def test_index_and_search(spark, tmp_path, capsys):
    """The five documents of a search corpus, through files and commands."""
    lines = tmp_path / "corpus.txt"
    lines.write_text("ЭсМинЕц конвой эсминец\nконвой конвой фрегат\n\nлес море корабль\r\nэсминец фрегат\nконвой корабль\n", encoding="utf-8")
    said = []
    assert main(["index", str(lines), str(tmp_path / "index")], spark, said.append) == 0
    assert said == ["indexed docs: 5"]
    for query, hits in (
        ("эсминец && конвой", ["1\t4.791759"]),
        ("эсминец || конвой", ["1\t4.791759", "2\t2.810930", "4\t1.693147", "5\t1.405465"]),
        ("!конвой", ["3\t0.000000", "4\t0.000000"]),
        ("эсминец && (конвой || фрегат)", ["1\t4.791759", "4\t3.386294"]),
        ("эсминец конвой", ["1\t4.791759", "2\t2.810930", "4\t1.693147", "5\t1.405465"]),
        ("лес && фрегат", []),
        ("нигде", []),
    ):
        said.clear()
        assert main(["search", str(tmp_path / "index"), query], spark, said.append) == 0
        assert said == hits, query


def test_exit_codes(spark, tmp_path):
    assert main([], spark) == main(["search", "x"], spark) == main(["find", "x", "y"], spark) == 1
    assert main(["search", str(tmp_path / "nowhere"), "x"], spark) == 2
    assert main(["index", str(tmp_path / "nowhere"), str(tmp_path / "i")], spark) == 2


def test_config(tmp_path):
    settings = {"logic": {"delay_sec": 0.5, "recrawl_interval_sec": 60}, "seeds": {"type": "pages_list", "pages_list_path": "p.json", "base_url": "https://x/", "source_name": "x"}}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    config = read_config(str(tmp_path / "c.json"))
    assert (config.delay_sec, config.recrawl_interval_sec, config.pages_list_path, config.max_documents) == (0.5, 60, "p.json", 10**9)
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("logic:\n  delay_sec: 0.5\n  recrawl_interval_sec: 60\nseeds:\n  type: pages_list\n  pages_list_path: p.json\n  base_url: 'https://x/'\n  source_name: x\n")
    assert read_config(str(tmp_path / "c.yaml")) == config
    (tmp_path / "c.yaml").write_text("logic: {delay_sec: 1, recrawl_interval_sec: 1}\nseeds: {type: other}\n")
    with pytest.raises(ValueError, match="other"):
        read_config(str(tmp_path / "c.yaml"))
