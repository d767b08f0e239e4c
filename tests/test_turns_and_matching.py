"""Speakers of turns in order, and which character a name means."""

from pyspark.sql import functions as F

from loomspark.operators import characters as lib
from loomspark.operators import matching, speakers, turns
from loomspark.operators.turns import Person, State, TurnWords

PEOPLE = [Person(1, "萧炎", frozenset({"岩枭"}), "male"), Person(2, "萧薰儿", frozenset(), "female"), Person(3, "云岚长老", frozenset({"大哥"}), "male"), Person(4, "林修哥", frozenset(), "male")]


def test_pronouns_go_to_the_nearest_of_the_gender():
    s = State(PEOPLE, TurnWords())
    assert s.turn("他点头", "", "他", [], []) == ("萧炎", 0.4, "pronoun_activity")
    assert s.turn("", "", "萧薰儿", [], []) == ("萧薰儿", 1.0, "hint")
    name, sure, how = s.turn("", "萧薰儿看着远处", "她", [], [])
    assert (name, how) == ("萧薰儿", "pronoun_local_window") and abs(sure - 0.95) < 1e-9
    name, sure, how = s.turn("", "他对萧炎点头", "他", [], ["云岚长老"])
    assert (name, how) == ("云岚长老", "pronoun_local_window")  # a fresh mention before a speaker in object position
    assert s.turn("", "", "它", [], []) == (None, 0.0, "none")


def test_forms_of_address_titles_and_actions():
    s = State(PEOPLE, TurnWords())
    assert s.turn("", "", "萧炎", [], [])[0] == "萧炎"
    assert s.turn("哥，走吧", "", None, [], [])[:2] == ("萧炎", 0.6)  # not the one addressed; the most active of the others
    assert s.turn("", "", "林修哥", [], [])[0] == "林修哥"
    assert s.by_trigger("哥，走吧") == ("萧炎", 0.7, "address_turn")  # of the recent speakers one is left
    assert s.turn("", "", "云岚长老", [], [])[0] == "云岚长老"
    assert s.by_trigger("哥，走吧") is None
    assert s.by_trigger("长老来了") == ("云岚长老", 0.8, "title")
    assert s.turn("长老来了", "", None, [], [])[1:] == (0.4, "address")  # gathered first, so it stands for that name
    s = State(PEOPLE, TurnWords())
    assert s.turn("长老来了", "", None, [], []) == ("云岚长老", 0.8, "title")
    s.turn("", "", "萧炎", [], [])
    assert s.by_trigger("萧炎转身就走") == ("萧炎", 0.65, "action") and s.by_trigger("萧炎" + "。" * 20 + "转身") is None
    assert s.turn("我是林修哥。", "", None, [], []) == ("林修哥", 0.9, "introduction")


def test_an_unknown_top_candidate_is_nobody():
    s = State(PEOPLE, TurnWords())
    assert s.turn("", "", None, [("路人", 0.9), ("萧炎", 0.8)], []) == (None, 0.0, "none")
    assert s.turn("", "", None, [("他", 0.99), ("岩枭", 0.8)], []) == ("萧炎", 0.8, "option")
    assert s.last == "萧炎" and s.counter == 1
    assert [s.turn(None, None, None, [], []) for _ in range(2)][0] == (None, 0.0, "none") or s.last == "萧炎"


def test_state_is_bounded():
    many = [Person(i, f"人{i:02}", frozenset(), "male") for i in range(30)]
    s = State(many, TurnWords())
    for p in many:
        s.turn("", "", p.name, [], [p.name])
    assert len(s.recent) == 10 and len(s.mentions) == 20 and s.recent[-1] == "人29"


def test_turns_of_chapters_and_projects(spark):
    schema = "project long, chapter int, turn int, text string, before string, hint string, options array<struct<name:string,confidence:double>>, mentioned array<string>"
    rows = [(1, 1, 2, "", "", "他", None, None), (1, 1, 1, "", "", "萧炎", None, None), (1, 2, 1, None, None, "他", [], []), (2, 1, 1, "", "", "萧炎", None, None), (3, 1, 1, "", "", "萧炎", None, None)]
    df = spark.createDataFrame(rows, schema)
    people = spark.createDataFrame([(1, 1, "萧炎", [], "male"), (1, 2, "阿大", [], "male"), (2, 3, "别人", None, None)], "project long, id long, name string, aliases array<string>, gender string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in turns.resolve_turns(df, people, ["project", "chapter"], "turn", TurnWords(), by=["project"]).collect()}
    assert got[1, 1, 1] == ("萧炎", 1.0, "hint") and got[1, 1, 2][0] == "萧炎" and got[1, 2, 1] == ("萧炎", 0.4, "pronoun_activity")
    assert got[2, 1, 1] == got[3, 1, 1] == (None, 0.0, "none") and len(got) == 5
    one = turns.resolve_turns(df.drop("project"), people.drop("project"), ["chapter"], "turn", TurnWords())
    assert one.count() == 5
    assert turns.resolve_turns(df.limit(0), people, ["project", "chapter"], "turn", TurnWords(), by=["project"]).count() == 0


def test_titles_and_endings(spark):
    people = spark.createDataFrame([(1, 1, "云岚长老", ["大哥"]), (1, 2, "青木长老", None), (1, 3, "黑甲骑士", []), (1, 4, "少女", []), (2, 5, "长老", [])], "project int, id int, name string, aliases array<string>")
    wanted = spark.createDataFrame([(1, k) for k in ("云岚长老", "大哥", "长老", "岚长老", "骑士", None, "", "白发云岚长老", "银甲骑士", "红衣少女", "红衣少女", "路人")] + [(2, "长老")], "project int, key string")
    got = {(r.project, r.key): (r.id, r.confidence, r.how) for r in matching.match_titles(wanted, people, ["project"]).collect()}
    none = (None, None, None)
    assert got == {(1, "云岚长老"): (1, 1.0, "name"), (1, "大哥"): (1, 0.9, "alias"), (1, "长老"): none, (1, "岚长老"): (1, 0.85, "title"), (1, "骑士"): (3, 0.85, "title"), (1, None): none, (1, ""): none, (1, "白发云岚长老"): none, (1, "银甲骑士"): none, (1, "红衣少女"): none, (1, "路人"): none, (2, "长老"): (5, 1.0, "name")}
    out = matching.match_candidates(wanted, people, ["project"], ("骑士", "少女", "长老"))
    got = {(r.project, r.key): (r.id, r.how) for r in out.collect()}
    assert got[1, "白发云岚长老"] == (1, "suffix") and got[1, "银甲骑士"] == (3, "core") and got[1, "红衣少女"] == (4, "suffix") and got[1, "岚长老"] == (1, "core") and got[1, "路人"] == (None, None)
    assert out.count() == 13 and matching.match_candidates(wanted, people.limit(0), ["project"], ()).where("id is not null").count() == 0


def test_links_and_backfill_go_by_content(spark):
    people = spark.createDataFrame([(1, 1, "萧炎", [])], "project int, id int, name string, aliases array<string>")
    found = spark.createDataFrame([(1, "萧炎哥", "PER", 0.5)] * 2 + [(1, "路人", "PER", 0.9)], "project int, text string, type string, confidence double")
    assert sorted((r.text, r.standard_name) for r in lib.link_entities(found, people).collect() if r.is_linked) == [("萧炎哥", "萧炎")] * 2
    said = spark.createDataFrame([(1, "萧炎来了", None), (1, "萧炎来了", "甲"), (1, "萧炎来了", "未知_1")], "d int, sentence string, speaker string")
    names = spark.createDataFrame([(1, "萧炎"), (1, "萧")], "d int, name string")
    assert sorted(r.speaker for r in speakers.backfill_unknown(said, names, ["d"]).collect()) == sorted(["萧炎", "甲", "萧炎"])
    assert speakers.backfill_unknown(said, names.where(F.lit(False)), ["d"]).count() == 3
