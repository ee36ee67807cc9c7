"""The rule index finds what testing every rule finds."""

import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import rules
from auditlake.functions.paths import fnmatch_to_regex, glob_to_regex
from auditlake.operators import commands as C
from auditlake.operators import index as I
from auditlake.operators import paths as P
from auditlake.sources.tables import stored

PART = st.text("ab*?.", min_size=1, max_size=4)


@given(PART, st.text("ab.", min_size=1, max_size=5))
def test_whatever_fits_a_pattern_has_its_key(pattern, name):
    if re.search(fnmatch_to_regex(pattern).replace(r"\z", r"\Z"), name):
        key = I.name_key(pattern)
        assert key == "*" or key == f"={name}" or key[0] == "^" and name.startswith(key[1:]) or key[0] == "$" and name.endswith(key[1:])


@given(st.lists(PART, min_size=1, max_size=3).map("/".join), st.lists(st.text("ab.", min_size=1, max_size=4), min_size=1, max_size=4))
def test_whatever_fits_a_glob_has_its_key(pattern, parts):
    if re.search(glob_to_regex(pattern).replace(r"\z", r"\Z"), "/".join(parts)):
        key = I.glob_key(pattern)
        assert key == "*" or any(key == f"={p}" or key[0] == "^" and p.startswith(key[1:]) or key[0] == "$" and p.endswith(key[1:]) for p in parts)


def test_thousands_of_path_rules(spark):
    pick = random.Random(2)
    many = [(f"r{i}", "LOW", [pick.choice(["**/n{}", "**/n{}*", "**/*{}.x", "/d{}/**", "**/*{}*"]).format(pick.randint(0, 400)) for _ in range(2)], [], ["Read"], []) for i in range(1500)]
    paths = spark.createDataFrame([(i, "Read", f"/d{pick.randint(0, 400)}/n{pick.randint(0, 400)}/a{pick.randint(0, 400)}.x") for i in range(60)], "id long, tool string, path string")
    got = {r.id: r.rule for r in P.match_paths(paths, F.lit("/w"), F.lit("/h"), many).collect()}
    fits = lambda globs, path: any(re.search(glob_to_regex(g).replace(r"\z", r"\Z"), p) for g in globs for p in (path, path.lstrip("/")))
    want = {r.id: next((name for name, _, globs, *_ in many if fits(globs, r.path)), None) for r in paths.collect()}
    assert got == {i: name for i, name in want.items() if name}


def test_command_rules_meet_commands_without_a_nested_loop(spark, capsys):
    lines = spark.createDataFrame([(1, "rm -rf /"), (2, "mkfs.ext4 /dev/sda"), (3, "echo x >> ~/.bashrc"), (4, "ls"), (5, "sudo rm x")], "id long, line string")
    cmds = C.command_context(C.parse_log(lines, "id", "line"), F.lit("/home/dev/app"), F.lit("/home/dev"), F.lit(None).cast("string"), ["main"])
    found = C.match_commands(cmds, C.rule_table(spark, rules.COMMANDS))
    assert {(r.id, r.rule) for r in found.collect()} == {(1, "command-rm-root"), (1, "command-rm-recursive-outside-cwd"), (2, "command-mkfs"), (3, "command-shell-rc-write"), (5, "command-sudo")}
    found.explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_rules_are_broadcast_and_rows_never(spark, capsys):
    """a small table of rows whose keys multiply was broadcast by the driver, as the size of the rules is unknown to Spark."""
    rows = stored(spark.range(2000).select("id", F.lit("Read").alias("tool"), F.concat(F.lit("/d/"), F.col("id").cast("string"), F.lit("/.ssh/x")).alias("path")), "rows")
    found = P.match_paths(rows, F.lit("/w"), F.lit("/h"))
    assert found.count() == 2000
    found.explain()
    plan = capsys.readouterr().out
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_many_rules_are_joined_without_a_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Read", "/a/.ssh/id_rsa"), (2, "Read", "/a/b"), (3, "Read", None)], "id long, tool string, path string")
    want = {r.id: r.rule for r in P.match_paths(rows, F.lit("/w"), F.lit("/h")).collect()}
    monkeypatch.setattr(I, "FEW", 3)
    assert {r.id: r.rule for r in P.match_paths(rows, F.lit("/w"), F.lit("/h")).collect()} == want == {1: "path-ssh-key"}


def test_parsing_is_no_part_of_a_filter(spark):
    """Spark copied the folds that cut a line into the filters of what they give, and ran them there again."""
    lines = spark.createDataFrame([(1, "", "sudo rm -r x; ls", 0, "direct")], "id long, ord string, code string, depth int, origin string")
    found = C._parsed(lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [x.argv0 for x in found.orderBy("ord").collect()] == ["sudo", "ls"]
    assert not [x for x in plan.splitlines() if "Filter" in x and ("aggregate(" in x or "regexp_extract_all" in x)]
