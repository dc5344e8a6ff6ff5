"""Session names of any kind, and how often the text of a session log is parsed."""

import json
import re

from decoylens.sources import logs as L


def test_names_of_members(spark, tmp_path):
    event = {"eventid": "cowrie.session.connect", "timestamp": "2024-01-01T00:00:00Z"}
    names = ["10.0.0.1", "", "session", 'a "quoted" one', "back\\slash", "tab\there", "ключ", "10.0.0.1", "}{][", "$1"]
    members = [{name: [event] * (1 + at)} for at, name in enumerate(names)] + [{"first": [event], "session": [event, event]}, {"note": "text"}, {}]
    (tmp_path / "sessions_1.json").write_text(json.dumps(members, ensure_ascii=False))
    (tmp_path / "sessions_2.json").write_text(" [\n {  \"spaced\" : [" + json.dumps(event) + "]},\n 7, {'single': [" + json.dumps(event) + "]}]\n")
    (tmp_path / "sessions_3.json").write_text(json.dumps([{"kept": [event]}, {"lost": [event]}])[:-4])
    events, rejected = L.read_session_logs(spark, str(tmp_path))
    found = {r["session"]: r["count"] for r in events.groupBy("session").count().collect()}
    expected = {}
    for at, name in enumerate(names):
        expected[name] = expected.get(name, 0) + 1 + at
    for name, n in (("first", 1), ("session", 2), ("spaced", 1), ("single", 1), ("kept", 1)):
        expected[name] = expected.get(name, 0) + n
    assert found == expected
    assert [r["path"].rsplit("/", 1)[1] for r in rejected.collect()] == ["sessions_3.json"]


def test_texts_are_parsed_once(spark, tmp_path):
    (tmp_path / "sessions_1.json").write_text('[{"a": [{"eventid": "cowrie.session.connect"}]}]')
    events, _ = L.read_session_logs(spark, str(tmp_path))
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    members = r"from_json\(ArrayType\(StringType,true\), CASE"
    assert len(re.findall(members, plan)) == 1
    assert len(re.findall(r"from_json\(StructField\(eventid", plan)) == 1
