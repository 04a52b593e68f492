"""The command line, end to end."""

from __future__ import annotations

import json

from skein.__main__ import main
from tests.test_documents_beside import OVERLAY


def test_commands(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    say = lambda *a: (main(list(a), spark), capsys.readouterr())
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text("import os\n\ndef f(a):\n    print(a)\n    return os.getcwd()\n\nclass K:\n    def g(self):\n        return f(1)\n")
    code, _ = say("analyze", at("src"), at("g.json"), "--deterministic")
    graph = json.loads((tmp_path / "g.json").read_text())
    assert code == 0 and graph["meta"]["generated_at"] is None and {n["qualified_name"] for n in graph["nodes"]} >= {"m", "m.f", "m.K.g", "builtin:print"}
    assert {n["signature"] for n in graph["nodes"] if n.get("signature")} == {"def f(a)", "def g(self)"}
    assert say("validate", at("g.json"))[0] == 0
    node = next(n["id"] for n in graph["nodes"] if n["qualified_name"] == "m.f")
    overlay = OVERLAY | {"analysis_sha256": None, "edges": [OVERLAY["edges"][0] | {"source_id": node}]}
    (tmp_path / "o.json").write_text(json.dumps(overlay))
    assert say("validate-manual", at("o.json"), at("g.json"))[0] == 0 and say("merge", at("g.json"), at("o.json"), at("merged.json"))[0] == 0
    assert say("split", at("merged.json"), at("bundle"), "--node-chunk-size", "3")[0] == 0
    assert say("split", at("merged.json"), at("bundle"))[0] == 2 and say("split", at("merged.json"), at("bundle"), "--force")[0] == 0
    assert say("validate-bundle", at("bundle"))[0] == 0 and say("validate-bundle", at("bundle"), "--quick")[0] == 0 and say("validate-bundle", at("nowhere"))[0] == 2
    one, two = say("search", at("merged.json"), "M.K"), say("search", at("bundle"), "M.K")
    assert one[1].out == two[1].out and len(one[1].out.splitlines()) == 2 and say("search", at("bundle"), "x", "--limit", "0")[0] == 2
    code, told = say("report", at("merged.json"))
    assert code == 0 and json.loads(told.out)["nodes_by_kind"]["module"] == 1
    assert say("validate", at("o.json"))[0] == 2 and say("validate", at("none.json"))[0] == 2
