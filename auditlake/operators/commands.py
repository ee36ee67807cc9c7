"""Command log: shell lines to simple commands, and commands to rule matches.

A line is cut into words and operators by one regular expression; pipelines,
redirects, flags and wrappers are folds over those arrays, so a round needs no
shuffle. Code inside a command (`$( )`, `sh -c`, wrappers, literals in
interpreter code) becomes the next round's rows, up to `MAX_DEPTH` rounds; the
frontier is written after each round, and an empty one ends the loop.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions import scalars as S
from auditlake.functions.paths import basename, expand_path, fnmatch_to_regex, glob_match, glob_to_regex, is_root_target, outside_cwd
from auditlake.operators.config import with_fail_mode
from auditlake.operators.index import candidates, name_key
from auditlake.operators.policy import first_match, resolve, with_overlay
from auditlake.operators.report import cap_rows
from auditlake.sources.tables import ship, stored

MAX_DEPTH = 6
MAX_COMMANDS = 256
RECORDS = 8

# Command families, flags that take a value, and short flags with their long names.
SHELLS = ["sh", "bash", "zsh", "dash", "ksh", "ash", "busybox"]
INTERPRETERS = ["python", "python2", "python3", "node", "nodejs", "perl", "ruby", "php", "deno", "bun"]
WRAPPERS = {
    "env": "-u --unset -S --split-string",
    "command": "",
    "builtin": "",
    "exec": "",
    "nohup": "",
    "setsid": "",
    "stdbuf": "-i -o -e",
    "nice": "-n",
    "ionice": "-c -n -p",
    "time": "-o -f",
    "timeout": "-s --signal -k",
    "xargs": "-n -P -I -d -a -E -s",
    "sudo": "-u -g -p -C -h -U -r -t",
    "doas": "-u -C",
    "pkexec": "--user",
}
ALIASES = {
    "rm": "-r=--recursive -R=--recursive -f=--force -i=--interactive -d=--dir -v=--verbose",
    "cp": "-r=--recursive -R=--recursive -f=--force -a=--archive",
    "mv": "-f=--force -n=--no-clobber",
    "git": "-f=--force -D=--delete-force -d=--delete -n=--dry-run",
    "chmod": "-R=--recursive -f=--silent",
    "chown": "-R=--recursive",
    "find": "-delete=--delete -exec=--exec -execdir=--exec",
    "tar": "-x=--extract -c=--create -f=--file",
    "curl": "-o=--output -O=--remote-name -s=--silent -H=--header -d=--data -X=--request",
    "wget": "-O=--output-document -q=--quiet",
    "base64": "-d=--decode -D=--decode",
    "xxd": "-r=--revert",
    "openssl": "-d=--decrypt",
    "shred": "-u=--remove -z=--zero",
}
VALUE_FLAGS = {
    "git": "-m -C -c --message --work-tree --git-dir",
    "curl": "-H -d -X -o -u --header --data --request --output --user",
    "wget": "-O --output-document --header",
    "ssh": "-i -p -o -l",
    "tar": "-f --file -C",
    "grep": "-e -f --include --exclude",
    "sed": "-e -f -i",
    "awk": "-v -f",
    "docker": "-e -v --name -p --env --volume",
    "openssl": "-in -out -k -K -iv",
}
LIST_OPERATORS = [";;", "&&", "||", ";", "&", "\n", "(", ")"]
PIPES = ["|", "|&"]
UNRESOLVED = ["argv0_from_substitution", "argv0_is_variable", "interpreter_exec", "max_depth_exceeded", "too_many_commands", "recursion_limit"]

_ESCAPE, _SINGLE, _DOUBLE = r"\\(?s:.)?", r"'[^']*(?:'|\z)", r'"(?:\\(?s:.)|[^"\\])*+(?:"|\z)'
_SUB = r"\$\((?:[^()]|\((?:[^()]|\([^()]*\))*+\))*+(?:\)|\z)"
_TICK = r"`(?:\\(?s:.)|[^`\\])*+(?:`|\z)"
_PIECE = rf"{_ESCAPE}|{_SINGLE}|{_DOUBLE}|{_SUB}|{_TICK}|[^\s;&|()'\"\\`$]++|\$"
_TOKEN = rf"(;;|&&|\|\||;|\|&|\||&|\n|\(|\)|(?:{_PIECE})++)"
_REDIRECT = r"\A\d*(?:>>|>\||>&|>|<<<|<<|<&|<)\z"
_GLUED = r"\A\d*(?:>>|>\||>&|>|<)(.+)\z"
_ASSIGN = r"\A[A-Za-z_][A-Za-z0-9_]*="
_EXEC = r"(?i)os\.system|os\.popen|os\.exec|subprocess|Popen|child_process|execSync|execFileSync|spawnSync|\bexec\s*\(|\bsystem\s*\(|Runtime\.getRuntime|IO\.popen|Kernel\.system|shell_exec|passthru|popen\s*\("


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def _pieces(word: Column) -> Column:
    return _all(word, f"({_PIECE})", 1)


def _text(piece: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(piece, rf'\A"|"\z|{_SUB}|{_TICK}', ""), r"\\((?s:.))", "$1")
    return (
        F.when(piece.startswith("'"), F.regexp_replace(piece, r"\A'|'\z", ""))
        .when(piece.startswith('"'), inner)
        .when(piece.startswith("$("), "")
        .when(piece.startswith("`"), "")
        .when(piece.startswith("\\"), F.substring(piece, 2, 1))
        .otherwise(piece)
    )


def _subs(word: Column) -> Column:
    """The code of every substitution in a word, also within double quotes."""
    open_ = F.filter(_pieces(word), lambda p: ~p.startswith("'"))
    found = F.flatten(F.transform(open_, lambda p: _all(p, f"({_SUB}|{_TICK})", 1)))
    return F.transform(found, lambda s: F.regexp_replace(s, r"\A(?:\$\(|`)|[)`]\z", ""))


def _word(word: Column) -> Column:
    cut = F.struct(F.array_join(F.transform(_pieces(word), _text), "").alias("text"), _subs(word).alias("subs"), word.rlike("['\"]").alias("quoted"))
    # Most words are one plain piece, which stands for itself.
    plain = F.struct(word.alias("text"), _strings([]).alias("subs"), F.lit(False).alias("quoted"))
    return F.when(word.rlike(r"[\\'\"$`]"), cut).otherwise(plain)


_WORD = "struct<text: string, subs: array<string>, quoted: boolean>"
_STAGE = f"struct<pipeline: int, words: array<{_WORD}>>"


def tokenize(code: Column) -> Column:
    """Words and operators of a line."""
    return _all(F.regexp_replace(code, r"\\\n", ""), _TOKEN, 1)


def split_pipelines(tokens: Column) -> Column:
    """Stages with the number of their pipeline."""
    none = F.array().cast(f"array<{_WORD}>")
    start = F.struct(F.lit(0).alias("p"), none.alias("cur"), F.array().cast(f"array<{_STAGE}>").alias("done"))
    flushed = lambda a: F.when(F.size(a["cur"]) > 0, F.array_append(a["done"], F.struct(a["p"].alias("pipeline"), a["cur"].alias("words")))).otherwise(a["done"])

    def step(a: Column, t: Column) -> Column:
        ends = F.struct((a["p"] + 1).alias("p"), none.alias("cur"), flushed(a).alias("done"))
        pipes = F.struct(a["p"].alias("p"), none.alias("cur"), flushed(a).alias("done"))
        more = F.struct(a["p"].alias("p"), F.array_append(a["cur"], _word(t)).alias("cur"), a["done"].alias("done"))
        return F.when(t.isin(LIST_OPERATORS), ends).when(t.isin(PIPES), pipes).otherwise(more)

    return F.aggregate(tokens, start, step, flushed)


def strip_redirects(words: Column) -> Column:
    """The words that stay, and the targets of redirects."""
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("redirects"), F.array().cast(f"array<{_WORD}>").alias("words"))

    def step(a: Column, w: Column) -> Column:
        target = lambda t: F.struct(F.lit(False).alias("skip"), F.array_append(a["redirects"], t).alias("redirects"), a["words"].alias("words"))
        opens = F.struct(F.lit(True).alias("skip"), a["redirects"].alias("redirects"), a["words"].alias("words"))
        stays = F.struct(F.lit(False).alias("skip"), a["redirects"].alias("redirects"), F.array_append(a["words"], w).alias("words"))
        glued = w["text"].rlike(_GLUED) & ~w["quoted"] & (F.size(w["subs"]) == 0)
        return F.when(a["skip"], target(w["text"])).when(w["text"].rlike(_REDIRECT) & ~w["quoted"], opens).when(glued, target(F.regexp_extract(w["text"], _GLUED, 1))).otherwise(stays)

    return F.aggregate(words, start, step)


def _leading(items: Column, test) -> Column:
    """How many items at the start pass the test."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda a, x: F.struct((a["n"] + (a["on"] & test(x)).cast("int")).alias("n"), (a["on"] & test(x)).alias("on"))
    return F.aggregate(items, start, step, lambda a: a["n"])


def _rest(items: Column, n: Column) -> Column:
    return F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0)))


def split_flags(argv0: Column, args: Column) -> Column:
    """Canonical flags and operands."""
    alias = F.create_map(*[F.lit(x) for c, text in ALIASES.items() for short, long in (p.split("=") for p in text.split()) for x in (f"{c} {short}", long)])
    # Sets of constants are looked up by hash, maps and arrays from end to end.
    known = [f"{c} {p.split('=')[0]}" for c, text in ALIASES.items() for p in text.split()]
    valued = [f"{c} {f}" for c, text in VALUE_FLAGS.items() for f in text.split()]
    key = lambda f: F.concat(argv0, F.lit(" "), f)
    named = lambda f: F.when(key(f).isin(known), F.element_at(alias, key(f))).otherwise(f)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("flags"), none.alias("operands"), F.lit(False).alias("skip"), F.lit(False).alias("end"))

    def step(a: Column, x: Column) -> Column:
        to = lambda flags=None, operand=None, skip=None, end=None: F.struct(
            (F.concat(a["flags"], flags) if flags is not None else a["flags"]).alias("flags"),
            (F.array_append(a["operands"], operand) if operand is not None else a["operands"]).alias("operands"),
            (skip if skip is not None else F.lit(False)).alias("skip"),
            (F.lit(True) if end else a["end"]).alias("end"),
        )
        long = F.regexp_extract(x, r"\A([^=]*)", 1)
        letters = F.transform(F.split(F.substring(x, 2, 1 << 20), ""), lambda c: named(F.concat(F.lit("-"), c)))
        takes = key(x).isin(valued)
        short = x.startswith("-") & (F.length(x) > 1) & ~x.rlike(r"\A-\d+\z")
        return (
            F.when(a["skip"], to())
            .when(a["end"], to(operand=x))
            .when(x == "--", to(end=True))
            .when(key(x).isin(known), to(F.array(named(x))))
            .when(x.startswith("--"), to(F.array(named(long)), skip=takes))
            .when(short & takes, to(F.array(named(x)), skip=F.lit(True)))
            .when(short, to(letters))
            .otherwise(to(operand=x))
        )

    return F.aggregate(args, start, step)


def _unwrapped(argv0: Column, args: Column) -> Column:
    """The code that a wrapper runs, quoted again; null for other commands."""
    valued = _strings([f"{c} {f}" for c, text in WRAPPERS.items() for f in text.split()])
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"), F.lit(False).alias("skip"), F.lit(False).alias("number"))

    def step(a: Column, x: Column) -> Column:
        takes = F.array_contains(valued, F.concat(argv0, F.lit(" "), x))
        number = (argv0 == "timeout") & ~a["number"] & x.rlike(r"\A\d+(?:\.\d+)?[smhd]?\z")
        drop = a["skip"] | (argv0.isin("env") & x.rlike(_ASSIGN)) | takes | (x.startswith("-") & (F.length(x) > 1)) | number
        on = a["on"] & drop
        return F.struct((a["n"] + on.cast("int")).alias("n"), on.alias("on"), (on & ~a["skip"] & takes).alias("skip"), (a["number"] | number).alias("number"))

    inner = _rest(args, F.aggregate(args, start, step, lambda a: a["n"]))
    quote = lambda v: F.when((v == "") | v.rlike(r"[\s\"'$`\\|&;<>()]"), F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("'\\''")), F.lit("'"))).otherwise(v)
    return F.when(argv0.isin(list(WRAPPERS)) & (F.size(inner) > 0), F.array_join(F.transform(inner, quote), " "))


def _after(args: Column, names: list[str]) -> Column:
    """The value of the first flag of the given names."""
    n = _leading(args, lambda x: ~x.isin(names))
    return F.get(args, n + 1)


_CHILD = "array<struct<code: string, depth: int, origin: string>>"


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with further columns that are computed once each, where Spark would copy the expressions into each filter above."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _parsed(frontier: DataFrame) -> DataFrame:
    """One round: a row for each command of the frontier (id, ord, code, depth, origin) with the code that it holds in turn."""
    # Cut once: a stage carries the first words of the stages that it stands among.
    first = lambda s: basename(F.get(s["words"], F.lit(0))["text"])
    heads = lambda s: F.transform(s, lambda x, i: F.struct(i.alias("i"), x["pipeline"].alias("p"), first(x).alias("argv0")))
    cut = F.transform(F.array(split_pipelines(tokenize(F.col("code")))), lambda s: F.struct(s.alias("stages"), heads(s).alias("heads")))
    stages = _once(frontier.select("id", "ord", "depth", "origin", "code"), cut=F.get(cut, F.lit(0))).drop("code")
    stages = stages.select("id", "ord", "depth", "origin", F.col("cut.heads").alias("heads"), F.posexplode_outer("cut.stages").alias("at", "stage"))
    clean = _once(stages.where("stage IS NOT NULL"), r=strip_redirects(F.col("stage.words")))
    clean = _once(clean, n=_leading(F.col("r.words"), lambda w: w["text"].rlike(_ASSIGN) & (F.size(w["subs"]) == 0)))
    clean = _once(clean, words=_rest(F.col("r.words"), F.col("n"))).where(F.size("words") > 0)
    head = F.get("words", F.lit(0))
    named = F.regexp_extract(F.get(head["subs"], F.lit(0)), r"\A\s*(?:which|type|whereis|command\s+-v)\s+(\S+)", 1)
    from_sub = (F.trim(head["text"]) == "") & (F.size(head["subs"]) > 0)
    rows = clean.withColumn("argv0", F.when(from_sub, F.when(F.coalesce(named, F.lit("")) == "", "unknown").otherwise(basename(named))).otherwise(basename(head["text"])))
    rows = rows.withColumn("args", F.transform(_rest(F.col("words"), F.lit(1)), lambda w: F.concat(w["text"], F.repeat(F.lit("$()"), F.size(w["subs"])))))
    # Neighbours by the first word of each stage of the pipeline.
    same = F.filter("heads", lambda x: x["p"] == F.col("stage.pipeline"))
    rows = rows.withColumn("same", same).withColumn("position", F.size(F.filter("same", lambda x: x["i"] < F.col("at"))))
    names = lambda test: F.transform(F.filter("same", test), lambda x: x["argv0"])
    rows = rows.withColumn("upstream", names(lambda x: x["i"] < F.col("at"))).withColumn("downstream", names(lambda x: x["i"] > F.col("at")))
    rows = rows.withColumn("f", split_flags(F.col("argv0"), F.col("args")))
    code = F.when(F.col("argv0").isin(INTERPRETERS), _after(F.col("args"), ["-c", "-e", "-E", "--eval", "--print"]))
    runs = F.coalesce(code.rlike(_EXEC), F.lit(False))
    child = lambda c, depth, origin: F.struct(c.alias("code"), depth.cast("int").alias("depth"), origin.alias("origin"))
    below = F.col("depth") + 1
    literal = F.transform(F.filter(_all(code, r"'[^'\n]{2,400}'|\"[^\"\n]{2,400}\""), lambda x: runs), lambda x: child(F.substring(x, F.lit(2), F.length(x) - 2), below, F.lit("interpreter")))
    inner = F.concat(
        F.transform(F.flatten(F.transform("words", lambda w: w["subs"])), lambda c: child(c, below, F.lit("subshell"))),
        F.array(child(_unwrapped(F.col("argv0"), F.col("args")), F.col("depth"), F.col("origin"))),
        F.array(child(F.when(F.col("argv0").isin(SHELLS), _after(F.col("args"), ["-c"])), below, F.lit("subshell"))),
        F.coalesce(literal, F.array().cast(_CHILD)),
    )
    warnings = F.array_compact(F.array(F.when(from_sub & (F.coalesce(named, F.lit("")) == ""), "argv0_from_substitution"), F.when(F.trim(head["text"]).startswith("$"), "argv0_is_variable"), F.when(runs, "interpreter_exec")))
    return rows.select(
        "id",
        F.concat("ord", F.format_string("/%04d", F.col("at"))).alias("ord"),
        "argv0",
        "args",
        F.array_sort(F.array_distinct("f.flags")).alias("flags"),
        F.col("f.operands").alias("operands"),
        "depth",
        F.when((F.col("position") > 0) & (F.col("origin") == "direct"), "pipe").otherwise(F.col("origin")).alias("origin"),
        F.col("stage.pipeline").alias("pipeline"),
        "position",
        "upstream",
        "downstream",
        F.col("r.redirects").alias("redirects"),
        F.transform(F.slice(F.col("r.words"), F.lit(1), F.col("n")), lambda w: w["text"]).alias("assignments"),
        warnings.alias("warnings"),
        F.filter(inner, lambda c: F.coalesce(F.trim(c["code"]) != "", F.lit(False))).alias("inner"),
        runs.alias("runs"),
    )


def parse_log(lines: DataFrame, id_col: str, line_col: str, rounds_at_most: int = 64) -> DataFrame:
    """One row per simple command of every line, in the order of ord. Bad input gives a warning, never an error.

    Rounds end when nothing is left to parse. Wrappers of wrappers stay at one depth; what
    is still open after `rounds_at_most` rounds gives its command the warning `recursion_limit`.
    """
    frontier = lines.select(F.col(id_col).alias("id"), F.lit("").alias("ord"), F.coalesce(line_col, F.lit("")).alias("code"), F.lit(0).alias("depth"), F.lit("direct").alias("origin"))
    rounds = []
    # A wrapper's code stays at its depth, so rounds are bounded apart from the depth.
    for turn in range(rounds_at_most):
        done = stored(_parsed(frontier), "commands")
        rounds.append(done)
        frontier = done.select("id", F.posexplode("inner").alias("k", "c"), "ord").select("id", F.concat("ord", F.format_string(".%04d", F.col("k"))).alias("ord"), "c.*").where(F.col("depth") <= MAX_DEPTH)
        if frontier.isEmpty():
            break
    else:
        rounds[-1] = rounds[-1].withColumn("warnings", F.when(F.size("inner") > 0, F.array_append("warnings", F.lit("recursion_limit"))).otherwise(F.col("warnings")))
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    deep = F.when(F.exists("inner", lambda c: c["depth"] > MAX_DEPTH), F.array(F.lit("max_depth_exceeded"))).otherwise(F.array().cast("array<string>"))
    unknown = every.where("runs").select("id", F.concat("ord", F.lit("!")).alias("ord"), F.lit("unknown").alias("argv0"), (F.col("depth") + 1).alias("depth"), F.lit("interpreter").alias("origin"))
    return every.withColumn("warnings", F.concat("warnings", deep)).drop("inner", "runs").unionByName(unknown, allowMissingColumns=True)


def parse_limits(cmds: DataFrame) -> DataFrame:
    """C11: a line's first commands up to the limit; where there are more, the last that stays carries a warning."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    rows = cmds.withColumn("_n", n).where(F.col("_n") <= MAX_COMMANDS + 1)
    over = F.when(F.col("_n") > MAX_COMMANDS, F.array_append(F.coalesce("warnings", F.array().cast("array<string>")), F.lit("too_many_commands"))).otherwise(F.col("warnings"))
    return rows.withColumn("warnings", over).drop("_n")


def command_context(cmds: DataFrame, cwd: Column, home: Column, branch: Column, protected: list[str]) -> DataFrame:
    """Expanded operands and redirects, targets outside the working directory or at a root, protected branches."""
    patterns = _strings([fnmatch_to_regex(p) for p in protected])
    none = F.array().cast("array<string>")
    full = lambda c: F.transform(F.coalesce(F.col(c), none), lambda o: expand_path(o, cwd, home))
    rows = cmds.withColumn("expanded_operands", full("operands")).withColumn("expanded_redirects", full("redirects"))
    pairs = F.arrays_zip(F.coalesce("operands", none).alias("operands"), F.col("expanded_operands"))
    fits = lambda v: F.exists(patterns, lambda p: F.rlike(v, p))
    return (
        rows.withColumn("outside", F.exists(pairs, lambda x: ~x["operands"].startswith("-") & outside_cwd(x["expanded_operands"], cwd)))
        .withColumn("root", F.exists(pairs, lambda x: is_root_target(x["operands"], x["expanded_operands"], cwd, home)))
        .withColumn("protected", F.exists(F.coalesce("operands", none), fits) | F.coalesce(fits(branch), F.lit(True)))
    )


_LISTS = ["argv0", "argv0_not", "args_contain_all", "args_contain_any", "args_not_contain_any", "flags_all", "flags_any", "flags_not_any", "args_regex_any", "origin_in", "piped_to_any", "piped_from_any", "target_glob", "redirect_glob"]
_SWITCHES = ["branch_protected", "branch_unprotected", "target_outside_cwd", "target_root", "target_dynamic", "require_operands"]
_COMPILE = {"argv0": fnmatch_to_regex, "argv0_not": fnmatch_to_regex, "piped_to_any": fnmatch_to_regex, "piped_from_any": fnmatch_to_regex, "target_glob": glob_to_regex, "redirect_glob": glob_to_regex}


def _rule_row(pos: int, r: dict) -> tuple:
    m = r["match"]
    index = sorted({name_key(x) for x in m["argv0"]}) if m.get("argv0") else ["*"]
    return (pos, r["id"], r["class"], r["severity"], index, *([_COMPILE.get(k, str)(x) for x in m[k]] if k in m else None for k in _LISTS), *(m.get(k) for k in _SWITCHES))


_RULE = ", ".join(["rule_pos int", "rule string", "class string", "severity string", "index array<string>", *(f"m_{k} array<string>" for k in _LISTS), *(f"m_{k} boolean" for k in _SWITCHES)])


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Command rules as a small wide table; names and globs become regular expressions."""
    return spark.createDataFrame([_rule_row(i, r) for i, r in enumerate(rules)], _RULE)


def user_rule_table(extra: DataFrame) -> DataFrame:
    """What users add (user_name, kind, rule: JSON) as rules of their own: user_name, the columns of rule_table and `pattern` of a regex rule.

    They come after the rules of all.
    """
    fields = [f.name for f in T.StructType.fromDDL(_RULE).fields]

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(user, *_rule_row(2000, r), r["match"].get("pattern") if kind == "regex" else None) for user, kind, r in zip(batch["user_name"], batch["kind"], map(json.loads, batch["rule"]), strict=True)]
            yield pd.DataFrame(rows, columns=["user_name", *fields, "pattern"])

    ship(extra.sparkSession)
    return extra.select("user_name", "kind", "rule").mapInPandas(compiled, f"user_name string, {_RULE}, pattern string")


_REGEXES = ["argv0", "argv0_not", "args_regex_any", "piped_to_any", "piped_from_any", "target_glob", "redirect_glob"]


def rule_error(rules: DataFrame) -> DataFrame:
    """The rules with `error`: the pattern that doesn't compile, or null. Each is tried once, where the rules are."""
    given = F.concat(*(F.coalesce(F.col(f"m_{k}"), _strings([])) for k in _REGEXES), F.array(F.col("pattern")) if "pattern" in rules.columns else _strings([]))
    tried = F.filter(F.array_compact(given), lambda p: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), p, F.lit("")).isNull())
    return rules.withColumn("error", F.concat(F.lit("pattern doesn't compile: "), F.get(tried, F.lit(0))))


def match_commands(cmds: DataFrame, rules: DataFrame, user: bool = False) -> DataFrame:
    """Every (command, rule) whose predicates all hold; a missing predicate holds.

    Rules meet commands by an index on names, so that predicates are tested on candidates alone. With `user`, both sides have
    user_name, and a rule holds for its user.
    """
    none = F.array().cast("array<string>")
    col = lambda c: F.coalesce(F.col(c), none)
    rx = lambda v, k: F.exists(F.col(f"m_{k}"), lambda p: F.rlike(v, p))
    tests = {
        "argv0": rx(F.col("argv0"), "argv0"),
        "argv0_not": ~rx(F.col("argv0"), "argv0_not"),
        "args_contain_all": F.size(F.array_except("m_args_contain_all", col("args"))) == 0,
        "args_contain_any": F.arrays_overlap("m_args_contain_any", col("args")),
        "args_not_contain_any": ~F.arrays_overlap("m_args_not_contain_any", col("args")),
        "flags_all": F.size(F.array_except("m_flags_all", col("flags"))) == 0,
        "flags_any": F.arrays_overlap("m_flags_any", col("flags")),
        "flags_not_any": ~F.arrays_overlap("m_flags_not_any", col("flags")),
        "args_regex_any": rx(F.array_join(col("args"), " "), "args_regex_any"),
        "origin_in": F.array_contains("m_origin_in", F.col("origin")),
        "piped_to_any": F.exists(col("downstream"), lambda v: rx(v, "piped_to_any")),
        "piped_from_any": F.exists(col("upstream"), lambda v: rx(v, "piped_from_any")),
        "target_glob": F.exists(F.array_union(col("operands"), col("expanded_operands")), lambda v: glob_match(F.col("m_target_glob"), v)),
        "redirect_glob": F.exists(F.array_union(col("redirects"), col("expanded_redirects")), lambda v: glob_match(F.col("m_redirect_glob"), v)),
    }
    switches = {
        "branch_protected": F.col("protected"),
        "branch_unprotected": ~F.col("protected"),
        "target_outside_cwd": F.col("outside"),
        "target_root": F.col("root"),
        "target_dynamic": F.exists(col("operands"), lambda o: o.contains("$()")),
        "require_operands": F.size(col("operands")) > 0,
    }
    where = F.lit(True)
    for k, t in tests.items():
        where = where & (F.col(f"m_{k}").isNull() | F.coalesce(t, F.lit(False)))
    for k, t in switches.items():
        where = where & (~F.coalesce(F.col(f"m_{k}"), F.lit(False)) | F.coalesce(t, F.lit(False)))
    target = F.coalesce(F.get(col("operands"), F.lit(0)), F.get(col("redirects"), F.lit(0)), F.col("argv0"))
    found = ["id", "ord", "rule_pos", "rule", "class", "severity", target.alias("target")]
    names = F.array_compact(F.array("argv0"))
    return candidates(cmds, names, rules, ["user_name"] if user else None).where(where).select(*(["user_name"] if user else []), *found)


def escalate(decision: Column, unresolved: Column, level: Column | str) -> Column:
    """Under a strict policy, what can't be resolved is asked for unless something stronger was decided."""
    weak = F.coalesce(S.decision_rank(decision), F.lit(0)) < S.decision_rank(F.lit("ask"))
    strict = (F.lit(level) if isinstance(level, str) else level) == "strict"
    return F.when(F.coalesce(unresolved, F.lit(False)) & weak & strict, "ask").otherwise(decision)


def classify_commands(
    log: DataFrame,
    rules: DataFrame,
    raw: list[tuple],
    levels: DataFrame,
    exemptions: DataFrame,
    today: str,
    protected: list[str],
    level: str = "warn",
    ttl_hours: float = 24,
    overlay: DataFrame | None = None,
    extra: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The verdict on every event of a command log, and its audit records.

    log: event_id, line, cwd, home, branch, session_id, agent_id, ts, and with overlay or extra user_name. raw: (rule, class,
    severity, pattern) of rules on the line itself. overlay: what users tighten (overlays); extra: rules that users add
    (extra_rules), each for its own user's lines. Levels, exemptions and session memory are applied to every match (L02); the
    most restrictive decides, the first of equals (A08); what can't be resolved is asked for under a strict policy, a user's
    floor included (P14); an event has at most `RECORDS` records (W03). A line is parsed once for each place it is used in.

    A rule that can't be evaluated, as its pattern doesn't compile, stops nothing: the others are applied, and each event that
    it should have judged is asked for, as this control blocks, with a record PARSER_ERROR whose evidence says why (L04).

    Returns verdicts (event_id, decision: null lets pass, rule) and records (event_id, rule, class, severity, level, target, outcome, error).
    """
    users = overlay is not None or extra is not None
    place = {c: F.coalesce(c, F.lit("")) for c in ("line", "cwd", "home", "branch")}
    # A line and its place are joined by a digest, not as texts.
    key = F.unhex(F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in place.items()))).cast("binary"), 256))
    events = log.select("event_id", key.alias("id"), *(c.alias(n) for n, c in place.items()), "session_id", "agent_id", "ts", *(["user_name"] if users else []))
    places = events.select("id", *place).dropDuplicates(["id"])
    events = events.drop(*place)
    cmds = stored(parse_limits(parse_log(places.select("id", "line"), "id", "line")), "parsed")
    known = command_context(cmds.join(places.drop("line"), "id"), F.col("cwd"), F.col("home"), F.nullif(F.col("branch"), F.lit("")), protected)
    checked = rule_error(rules)
    found = first_match(match_commands(known, checked.where("error IS NULL").drop("error")), ["ord"], ["id", "rule"]).drop("ord")
    hit = lambda i, r: F.when(F.col("line").rlike(r[3]), F.struct(F.lit(1000 + i).alias("rule_pos"), F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("class"), F.lit(r[2]).alias("severity"), F.lit(None).cast("string").alias("target")))
    if raw:
        whole = places.select("id", F.explode(F.array_compact(F.array(*(hit(i, r) for i, r in enumerate(raw))))).alias("r"))
        found = found.unionByName(whole.select("id", "r.*"))
    matches = events.join(found, "id").drop("id")
    # The rules of all are a constant, and so is what is wrong with them.
    wrong = [r["error"] for r in checked.where("error IS NOT NULL").select("error").collect()]
    errors = events.select("event_id", F.lit(wrong[0]).alias("error")) if wrong else None
    if extra is not None:
        own = stored(rule_error(user_rule_table(extra)), "user-rules")
        good = own.where("error IS NULL").drop("error")
        used = events.select("id", "user_name").join(own.select("user_name").distinct(), "user_name", "left_semi").distinct()
        by_command = match_commands(known.join(used, "id"), good.where("pattern IS NULL"), user=True)
        lines = places.select("id", "line").join(used, "id").join(good.where("pattern IS NOT NULL"), "user_name").where(F.rlike("line", F.col("pattern")))
        by_line = lines.select("user_name", "id", F.lit("").alias("ord"), "rule_pos", "rule", "class", "severity", F.lit(None).cast("string").alias("target"))
        more = first_match(by_command.unionByName(by_line), ["ord"], ["user_name", "id", "rule"]).drop("ord")
        matches = matches.unionByName(events.join(more, ["user_name", "id"]).drop("id"))
        broken = events.join(own.where("error IS NOT NULL").groupBy("user_name").agg(F.min("error").alias("error")), "user_name").select("event_id", "error")
        errors = broken if errors is None else errors.unionByName(broken)
    resolved = stored(resolve(matches, levels, exemptions, today, ttl_hours, level, overlay), "resolved")

    weight = F.when(F.col("suppressed"), S.decision_rank(F.lit("log"))).otherwise(S.decision_rank(F.col("decision")))
    best = resolved.groupBy("event_id").agg(F.max_by(F.struct("rule", "decision", (F.col("exempt") | F.col("suppressed")).alias("quiet")), F.struct(weight, -F.col("rule_pos"))).alias("b"))
    open_ = cmds.where(F.arrays_overlap("warnings", _strings(UNRESOLVED))).select("id").distinct().withColumn("open", F.lit(True))
    # The policy's level for an event: that of all, or its user's floor.
    policy = with_overlay(events, overlay).withColumn("policy", F.coalesce(S.harder(F.lit(level), F.col("floor")), F.lit(level))).drop("floor", "own") if overlay is not None else events.withColumn("policy", F.lit(level))
    final = policy.select("event_id", "id", "policy").join(open_, "id", "left").join(best, "event_id", "left")
    failed = errors.groupBy("event_id").agg(F.min("error").alias("error")) if errors is not None else None
    final = final.join(failed, "event_id", "left") if failed is not None else final.withColumn("error", F.lit(None).cast("string"))
    asked = F.coalesce(escalate(F.col("b.decision"), F.col("open"), F.col("policy")) != F.coalesce("b.decision", F.lit("")), F.lit(False))
    loud = ~F.coalesce("b.quiet", F.lit(False)) & ~F.coalesce(F.col("b.decision") == "log", F.lit(False))
    decision = F.when(asked, "ask").when(loud, F.col("b.decision"))
    failing = F.col("error").isNotNull() & (F.coalesce(S.decision_rank(decision), F.lit(0)) < S.decision_rank(F.lit("ask")))
    final = final.select(
        "event_id",
        F.when(failing, with_fail_mode(F.lit(None).cast("string"), F.lit("command"), ["command"])).otherwise(decision).alias("decision"),
        F.when(failing, "PARSER_ERROR").when(asked, "PARSER_UNRESOLVED").when(loud, F.col("b.rule")).alias("rule"),
        F.col("policy"),
        asked.alias("asked"),
        "error",
    )

    text = lambda v, name: F.lit(v).cast("string").alias(name)
    kept = cap_rows(resolved, RECORDS, ["event_id"], ["rule_pos"]).select("event_id", "rule", "class", "severity", "level", "target", "outcome", text(None, "error"))
    more = final.where("asked").select("event_id", text("PARSER_UNRESOLVED", "rule"), text("internal", "class"), text("MEDIUM", "severity"), text("strict", "level"), text(None, "target"), text("asked", "outcome"), text(None, "error"))
    bad = final.where("error IS NOT NULL").select("event_id", text("PARSER_ERROR", "rule"), text("internal", "class"), text("LOW", "severity"), F.col("policy").alias("level"), text(None, "target"), text("error", "outcome"), "error")
    return final.select("event_id", "decision", "rule"), kept.unionByName(more).unionByName(bad)
