import re

import pytest

from contextlake.functions.patterns import glob_regex, ignore_rule, include_lines


@pytest.mark.parametrize(
    ("line", "path", "hit"),
    [
        ("*.log", "a/b.log", True), ("*.log", "b.log.txt", False), ("/a", "a", True), ("/a", "b/a", False), ("a/b", "a/b", True), ("a/b", "x/a/b", False),
        ("**/b", "x/y/b", True), ("**/b", "b", True), ("a/**", "a/x/y", True), ("a/**", "a", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
        ("doc?.md", "doc1.md", True), ("doc?.md", "doc12.md", False), ("d[0-2].md", "d1.md", True), ("d[!0-2].md", "d1.md", False), ("\\#x", "#x", True), ("\\!x", "!x", True),
        ("a.b", "aXb", False), ("x ", "x", True), ("*", "a/b", True),
    ],
)
def test_ignore_rule(line, path, hit):
    assert bool(re.search(ignore_rule(line).regex, path)) is hit


def test_ignore_rule_flags():
    assert ignore_rule("# note") is None and ignore_rule("  ") is None and ignore_rule("/") is None
    assert ignore_rule("!keep/").negated and ignore_rule("!keep/").directories_only


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("**/*.{js,ts}", "a/b.ts", True), ("**/*.{js,ts}", "b.py", False), ("src/**", "src/a/b", True), ("src/**", "src", True), ("*.md", "a.md", True), ("*.md", "x/a.md", False)],
)
def test_glob(glob, path, hit):
    assert bool(re.search(glob_regex(glob), path)) is hit


def test_glob_without_dot_hides_dotfiles():
    assert not re.search(glob_regex("**/*", dot=False), "a/.env") and re.search(glob_regex("**/*", dot=False), "a/env")
    assert re.search(glob_regex(".github/**", dot=False), ".github/x.yml")


def test_include_lines():
    assert include_lines("x\n# c\n/y\n") == ["**/x", "**/x/**", "y", "y/**"]


@pytest.mark.parametrize("glob,hits,misses", [
    ("!(a).txt", ["b.txt", "aa.txt", ".txt"], ["a.txt", "a.md", "d/b.txt"]), ("@(a|b)/x", ["a/x", "b/x"], ["ab/x", "/x"]), ("x?(yz)", ["x", "xyz"], ["xy", "xyzyz"]), ("+(ab)c", ["abc", "ababc"], ["c", "abac"]),
    ("*(ab)c", ["c", "ababc"], ["ac"]), ("{1..3}.md", ["1.md", "3.md"], ["4.md", "12.md"]), ("{c..a}", ["a", "b", "c"], ["d"]), ("{9..11}/*", ["10/x"], ["1/x"]), ("@(a|+(b|c)d)e", ["ae", "bcde"], ["be", "de"]),
    ("**/!(*.test).js", ["a.js", "x/b.js"], ["a.test.js", "x/y.test.js"]), ("a(b)", ["a(b)"], ["ab"]), ("@(a", ["@(a"], ["a"]), ("!(a|b)/!(c)", ["x/d"], ["a/d", "x/c"]), ("@([)|]|x)", [")", "|", "x"], ["a"]), ("{!(a),a/b}.c", ["x.c", "a/b.c"], ["a.c", "x/b.c"]), ("{d,e}/!(f)", ["d/g", "e/g"], ["d/f", "c/g"]),
])
def test_groups(glob, hits, misses):
    regex = re.compile(glob_regex(glob))
    assert all(regex.search(h) for h in hits) and not any(regex.search(m) for m in misses)
