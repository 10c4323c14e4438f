"""Labelled source snippets for the test corpus.

A mark ``⟦CODE|argument…⟧`` at the end of a line says what is expected there; marks are cut out before use.
``EXPECTED`` turns a code into the rule and its message. Labels are written by hand, but for SRC and SINK, which were taken
from the operator's own output and read through; a test finds the same places by patterns over the lines. DEF marks were set with the
operator's output at hand; which names are assigned at all is read off the lines (``definitions``).
"""

from __future__ import annotations

import re

EXPECTED = {
    "SEC001f": "Potential SQL injection via f-string formatting.",
    "SEC001p": "Potential SQL injection via % string formatting.",
    "SEC001t": "Potential SQL injection via .format() string formatting.",
    "SEC002s": "Dangerous function call: {0}() can lead to OS command injection.",
    "SEC002e": "Use of {0}() detected — potential code injection risk.",
    "SEC002h": "{0}() called with shell=True — command injection risk.",
    "SEC004u": "Insecure deserialization via {0}().",
    "SEC004y": "yaml.load() without SafeLoader — potential arbitrary code execution.",
    "SEC005h": "Weak hash algorithm: {0}() is not collision-resistant.",
    "SEC005r": "{0}() is not cryptographically secure.",
    "SEC006v": "Potential SSRF: {0}() called with a variable URL.",
    "SEC006f": "Potential SSRF: {0}() called with f-string URL.",
    "SEC007": "Silent exception handler — exceptions are caught but not logged.",
    "SEC008k": "Debug mode is enabled — exposes sensitive information in production.",
    "SEC008d": "DEBUG = True detected — should be False in production.",
    "SEC009": "Potential path traversal in {0}() with user-controlled input.",
    "SEC010": "Unsafe XML parser {0}() — may be vulnerable to XXE attacks.",
    "SEC014": "TOCTOU race condition — file existence check followed by file operation.",
    "CS001": "Function '{0}' is {1} lines long (max 50).",
    "CS002": "Function '{0}' has {1} parameters (max 5).",
    "CS003": "Function '{0}' has cyclomatic complexity {1} (max 10).",
    "CS004": "Code is nested {0} levels deep (max 4).",
    "CS005": "Import '{0}' appears to be unused.",
    "CS006": "Global variable(s) used: {0}",
    "CS007": "Bare except block catches all exceptions, including SystemExit and KeyboardInterrupt.",
    "PERF001": "List concatenation inside loop — use .append() or .extend() instead.",
    "PERF002": "Function '{0}' has a mutable default argument.",
    "PERF003": "Wildcard import: from {0} import *",
    "MAINT001": "Dead code — statement after {0} is unreachable.",
    "MAINT002f": "Public function '{0}' is missing a docstring.",
    "MAINT002c": "Class '{0}' is missing a docstring.",
    "MAINT003": "Function '{0}' has {1} return statements (max 4).",
    "MAINT004": "String literal '{0}' repeated {1} times — extract to a named constant.",
    "MAINT005": "assert used for security/auth check — disabled in optimized mode.",
    "MAINT006": "tempfile.mktemp() is insecure — race condition between name generation and file creation.",
    "TYPE001p": "Function '{0}' has unannotated parameters: {1}.",
    "TYPE001r": "Function '{0}' is missing a return type annotation.",
    "TYPE002p": "Parameter '{0}' in '{1}' annotated as Any — use a specific type.",
    "TYPE002r": "Return type of '{0}' is Any — use a specific type.",
    "TYPE003": "Parameter '{0}' defaults to None but is not annotated as Optional.",
    "ASYNC001": "Blocking call '{0}()' inside async function '{1}' — stalls the event loop.",
    "ASYNC002": "'{0}()' called without await — coroutine is never executed.",
    "ASYNC003": "Synchronous open() inside async function '{0}' blocks the event loop.",
    "ASYNC004": "asyncio.sleep(0) in a loop — consider a proper async queue or event instead.",
    "TAINT001v": "Tainted data flows into {0}() — {1}",
    "TAINT001k": "Tainted data flows into {0}() via keyword arg — {1}",
    "JSCS001": "Function '{0}' is approximately {1} lines long (max 50).",
    # Facts rather than findings: name, length, complexity of a function.
    "FN": "{0}|{1}|{2}",
    "FNW": "{0}|{1}|{2}",
    "PYFN": "{0}|{1}|{2}",
    # A name that holds untrusted data after the line; names without the mark don't.
    "DEF": "{0}",
    # Where data comes from (node, dotted name), and calls it must not reach (column, dotted name, danger).
    "SRC": "{0}|{1}",
    "SINK": "{0}|{1}|{2}",
}

PYTHON = [
    # 0: statements built from text
    '''import db
_ident = "users"
db.run(f"SELECT * FROM {_ident}")⟦SEC001f⟧
db.run("DELETE FROM t WHERE id=%s" % _ident)⟦SEC001p⟧
db.run("update t set a={}".format(_ident))⟦SEC001t⟧
db.run(f"hello {_ident}")
db.run("nothing %s" % _ident)
db.run("selection {}".format(_ident))
_q = "SELECT 1" + _ident
_n = f"{_ident}" f" drop {_ident}"⟦SEC001f⟧
''',
    # 1: commands and code
    '''import importlib
import os
import subprocess
_cmd = "ls"
os.system(_cmd)⟦SEC002s|os.system⟧⟦SINK|0|os.system|OS Command Injection⟧
os.popen(_cmd)⟦SEC002s|os.popen⟧⟦SINK|0|os.popen|OS Command Injection⟧⟦SRC|Attribute|os.popen⟧⟦SRC|Call|os.popen⟧
eval("1 + 1")⟦SEC002e|eval⟧⟦SINK|0|eval|Code Injection via eval()⟧
exec(_cmd)⟦SEC002e|exec⟧⟦SINK|0|exec|Code Injection via exec()⟧
compile(_cmd, "f", "exec")⟦SEC002e|compile⟧⟦SINK|0|compile|Code Injection via compile()⟧
__import__("os")⟦SEC002e|__import__⟧
subprocess.run(_cmd, shell=True)⟦SEC002h|subprocess.run⟧⟦SINK|0|subprocess.run|OS Command Injection⟧
subprocess.call(_cmd, shell=False)⟦SINK|0|subprocess.call|OS Command Injection⟧
subprocess.check_output([_cmd], shell=True)⟦SEC002h|subprocess.check_output⟧
importlib.import_module("x").system(_cmd)⟦SEC002s|system⟧
_obj = importlib
_obj.eval(_cmd)⟦SINK|0|_obj.eval|Code Injection via eval()⟧
''',
    # 2: loading and hashing
    '''import hashlib
import marshal
import pickle
import random
import shelve
import yaml
_blob = b"x"
pickle.loads(_blob)⟦SEC004u|pickle.loads⟧⟦SINK|0|pickle.loads|Unsafe Deserialization⟧
marshal.load(_blob)⟦SEC004u|marshal.load⟧
shelve.open("db")⟦SEC004u|shelve.open⟧⟦SRC|Attribute|shelve.open⟧⟦SRC|Call|shelve.open⟧
yaml.load(_blob)⟦SEC004y⟧⟦SINK|0|yaml.load|Unsafe YAML Deserialization⟧
yaml.load(_blob, Loader=yaml.SafeLoader)⟦SINK|0|yaml.load|Unsafe YAML Deserialization⟧
yaml.load(_blob, Loader=yaml.FullLoader)⟦SEC004y⟧⟦SINK|0|yaml.load|Unsafe YAML Deserialization⟧
yaml.load(_blob, yaml.SafeLoader)⟦SEC004y⟧⟦SINK|0|yaml.load|Unsafe YAML Deserialization⟧
yaml.unsafe_load(_blob)
hashlib.md5(_blob)⟦SEC005h|hashlib.md5⟧
hashlib.sha256(_blob)
hashlib.sha1(_blob).hexdigest()⟦SEC005h|hashlib.sha1⟧
random.random()⟦SEC005r|random.random⟧
random.choice([1])⟦SEC005r|random.choice⟧
random.shuffle([1])
''',
    # 3: requests, XML, debug flags
    '''import app
import httpx
import requests
import xml.etree.ElementTree
from lxml import etree
_url = "http://x"
requests.get(_url)⟦SEC006v|requests.get⟧⟦SINK|0|requests.get|Potential SSRF⟧
requests.post(f"http://{_url}/a")⟦SEC006f|requests.post⟧⟦SINK|0|requests.post|Potential SSRF⟧
requests.get("http://x")⟦SINK|0|requests.get|Potential SSRF⟧
httpx.get(_url + "/b")⟦SINK|0|httpx.get|Potential SSRF⟧
httpx.AsyncClient.get(_url)⟦SEC006v|httpx.AsyncClient.get⟧
requests.get(url=_url)⟦SINK|0|requests.get|Potential SSRF⟧
xml.etree.ElementTree.parse("f")⟦SEC010|xml.etree.ElementTree.parse⟧
etree.parse("f")
app.run(debug=True)⟦SEC008k⟧
app.run(debug=False)
DEBUG = True⟦SEC008d⟧
DEBUG = False
debug = True
A = DEBUG = True⟦SEC008d⟧
''',
    # 4: handlers, paths, check-then-open
    '''import os
import shutil
import sys
_path = "a"
try:
    _path = "b"
except ValueError:⟦SEC007⟧
    pass
try:
    _path = "c"
except:⟦CS007⟧⟦SEC007⟧
    "ignored"
try:
    _path = "d"
except OSError as _e:
    print(_e)
    pass
try:
    _path = "e"
except KeyError:
    _path()
open(input())⟦SEC009|open⟧⟦SRC|Call|input⟧⟦SRC|Call|open⟧
open(_path)⟦SRC|Call|open⟧
shutil.copy(_path, sys.argv[1])⟦SEC009|shutil.copy⟧⟦SRC|Attribute|sys.argv⟧
os.path.join("a", "input.txt")⟦SEC009|os.path.join⟧
os.path.join("a", _path)
if os.path.exists(_path):⟦SEC014⟧
    _f = open(_path)⟦DEF|_f⟧⟦SRC|Call|open⟧
if os.path.isfile(_path) and True:⟦SEC014⟧
    if _path:
        _f = open(_path)⟦DEF|_f⟧⟦SRC|Call|open⟧
if os.path.exists(_path):
    _f = 1
else:
    _f = open(_path)⟦DEF|_f⟧⟦SRC|Call|open⟧
''',
    # 5: long functions and long signatures
    "def _long():⟦CS001|_long|51⟧⟦PYFN|_long|51|1⟧\n" + "    x = 1\n" * 50
    + "def _fifty():⟦PYFN|_fifty|50|1⟧\n" + "    x = 1\n" * 49
    + '''def _many(self, a, b, c, d, e, f):⟦CS002|_many|6⟧⟦PYFN|_many|2|1⟧
    return a
def _five(self, a, b, c, d, e):⟦PYFN|_five|2|1⟧
    return a
def _kw(a, b, *args, c, d, e, f, **kw):⟦CS002|_kw|6⟧⟦PYFN|_kw|2|1⟧
    return a
def _pos(a, b, /, c, d, e, f):⟦PYFN|_pos|2|1⟧
    return a
_l = lambda a, b, c, d, e, f, g: a
''',
    # 6: decision points
    '''def _busy(a, b):⟦CS003|_busy|12⟧⟦PYFN|_busy|18|12⟧
    if a:
        return 1
    elif b:
        return 2
    for i in a:
        while b:
            b = b and a and i
    try:
        with a:
            assert a
    except ValueError:
        b = 1 if a else 2
    # a comment line
    def _inner(c):⟦PYFN|_inner|3|2⟧
        if c:
            return c
    return _inner

async def _quiet(a):⟦PYFN|_quiet|6|1⟧
    async for i in a:
        pass
    async with a:
        pass
    return [x for x in a if x if x]
''',
    # 7: nesting and globals
    '''_g = 0
def _deep(a):⟦PYFN|_deep|11|6⟧
    global _g⟦CS006|_g⟧
    if a:
        for i in a:
            while i:
                with a:
                    try:⟦CS004|5⟧
                        if i:⟦CS004|6⟧
                            _g = 1
                    finally:
                        _g = 2
def _chain(a):⟦PYFN|_chain|12|6⟧
    global _g, _h⟦CS006|_g, _h⟧
    if a == 1:
        _g = 1
    elif a == 2:
        _g = 2
    elif a == 3:
        _g = 3
    elif a == 4:
        _g = 4
    elif a == 5:⟦CS004|5⟧
        _g = 5
''',
    # 8: imports
    '''import os
import sys
import a.b.c⟦CS005|a.b.c⟧
import d.e
import numpy as np
import pandas as pd⟦CS005|pd⟧
from x import y, z⟦CS005|z⟧
from m import *⟦PERF003|m⟧
from . import *⟦PERF003|None⟧⟦CS005|*⟧
import os⟦CS005|os⟧
print(sys.path, d.e.f, np.x, y)
''',
    # 9: growth in loops, mutable defaults
    '''def _grow(items, out=[], *, seen={}):⟦PERF002|_grow⟧⟦PERF002|_grow⟧⟦PYFN|_grow|9|3⟧
    for a in items:
        out += [a]⟦PERF001⟧
        while a:
            out += [a, a]⟦PERF001⟧⟦PERF001⟧
            out += (a,)
            out -= [a]
    out += [1]
    return seen
def _tuple(a=(), b=None, c=set()):⟦PYFN|_tuple|2|1⟧
    return a
async def _agrow(items, out={1}):⟦PERF002|_agrow⟧⟦PYFN|_agrow|3|1⟧
    async for a in items:
        out += [a]
''',
    # 10: unreachable statements, docstrings
    '''class Open:⟦MAINT002c|Open⟧
    def run(self) -> int:⟦MAINT002f|run⟧⟦PYFN|run|4|1⟧
        return 1
        x = 2⟦MAINT001|return⟧
        y = 3
    def ok(self) -> None:⟦PYFN|ok|4|1⟧
        """Documented."""
        raise ValueError
        pass
    def _hidden(self):⟦PYFN|_hidden|18|4⟧
        while True:
            break
            "text"
        for i in []:
            continue
            i = 1⟦MAINT001|continue⟧
        else:
            return
            i = 2
        try:
            raise KeyError
            i = 3⟦MAINT001|raise⟧
        except KeyError:
            return
            i = 4
        finally:
            i = 5
class _Private:
    pass
class Doc:
    "doc"
async def fetch() -> None:⟦MAINT002f|fetch⟧⟦PYFN|fetch|4|2⟧
    if True:
        return
        "a" + "b"⟦MAINT001|return⟧
''',
    # 11: returns, literals, asserts, temporary names
    '''import tempfile
def _exits(a):⟦MAINT003|_exits|5⟧⟦PYFN|_exits|10|5⟧
    if a == 1:
        return 1
    if a == 2:
        return 2
    if a == 3:
        return 3
    if a == 4:
        return 4
    return 5
_a = "repeated"⟦MAINT004|repeated|3⟧
_b = ["repeated", " repeated "]
_c = "short"
_d = ["short", "short", "short"]
_e = ["twice!", "twice!"]
_f = ["breadth first"]
_g = "breadth first"⟦MAINT004|breadth first|3⟧
_h = "breadth first"
_i = ["abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH"] * 2
_j = ["abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH", "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH"]⟦MAINT004|abcdefghijklmnopqrstuvwxyz0123456789ABCD|3⟧
assert _a, "user must login"⟦MAINT005⟧
assert _b
assert (
    _c == "admin"
)
assert is_admin(_a)
tempfile.mktemp()⟦MAINT006⟧
tempfile.mkstemp()
mktemp("x")⟦MAINT006⟧
tempfile.get().mktemp()⟦MAINT006⟧
''',
    # 12: annotations
    '''import typing
from typing import Any, Optional
def f(a, b: int, *args, c, d: str = "x", **kw):⟦MAINT002f|f⟧⟦TYPE001p|f|a, c, args, kw⟧⟦TYPE001r|f⟧⟦PYFN|f|2|1⟧
    return a
def g(self, cls) -> int:⟦MAINT002f|g⟧⟦PYFN|g|2|1⟧
    return 1
def h(a: Any, *, b: typing.Any, c: "Any" = None) -> Any:⟦MAINT002f|h⟧⟦TYPE002p|a|h⟧⟦TYPE002p|b|h⟧⟦TYPE002r|h⟧⟦PYFN|h|2|1⟧
    return a
def _i(a: int = None, b: Optional[int] = None, c: int | None = None, d: None | int = None, e=None, f: None = None, g: str = "x", h: typing.Optional[int] = None, i: list[Any] = None) -> None:⟦TYPE003|a⟧⟦TYPE003|i⟧⟦CS002|_i|9⟧⟦PYFN|_i|2|1⟧
    return None
def _p(a: int = None, /, b: str = None) -> None:⟦TYPE003|a⟧⟦TYPE003|b⟧⟦PYFN|_p|2|1⟧
    return None
_l = lambda x, y=None: x
''',
    # 13: event loop
    '''import asyncio
import os
import requests
import time
async def _work(urls):⟦PYFN|_work|19|4⟧
    time.sleep(1)⟦ASYNC001|time.sleep|_work⟧
    await asyncio.sleep(1)
    asyncio.sleep(2)⟦ASYNC002|asyncio.sleep⟧
    t = asyncio.create_task(urls)
    asyncio.create_task(urls)⟦ASYNC002|asyncio.create_task⟧
    with open("f") as fh:⟦ASYNC003|_work⟧⟦SRC|Call|open⟧
        fh.close()
    async def _nested():⟦PYFN|_nested|3|1⟧
        requests.get("u")⟦ASYNC001|requests.get|_nested⟧⟦ASYNC001|requests.get|_work⟧⟦SINK|8|requests.get|Potential SSRF⟧
        os.open("f", 0)⟦SRC|Attribute|os.open⟧⟦SRC|Call|os.open⟧
    for u in urls:
        await asyncio.sleep(0)⟦ASYNC004⟧
        while u:
            await asyncio.sleep(0.0)⟦ASYNC004⟧⟦ASYNC004⟧
            await asyncio.sleep(0.5)
    await asyncio.sleep(0)
    await asyncio.sleep()
    return t, _nested
def _sync():⟦PYFN|_sync|3|1⟧
    time.sleep(1)
    open("g")⟦SRC|Call|open⟧
''',
    # 14: flows at module level
    '''import os
from flask import request
v1 = input("x")⟦DEF|v1⟧⟦SRC|Call|input⟧
os.system(v1)⟦SEC002s|os.system⟧⟦TAINT001v|os.system|OS Command Injection⟧⟦SINK|0|os.system|OS Command Injection⟧
v2 = v1 + "!"⟦DEF|v2⟧
v3 = f"{v2}"⟦DEF|v3⟧
eval(v3)⟦SEC002e|eval⟧⟦TAINT001v|eval|Code Injection via eval()⟧⟦SINK|0|eval|Code Injection via eval()⟧
v4 = input()⟦DEF|v4⟧⟦SRC|Call|input⟧
v4 = "safe"
os.system(v4)⟦SEC002s|os.system⟧⟦SINK|0|os.system|OS Command Injection⟧
v5 = input()⟦DEF|v5⟧⟦SRC|Call|input⟧
os.system(v5)⟦SEC002s|os.system⟧⟦SINK|0|os.system|OS Command Injection⟧
v5 = "late"
v6 = "a"
v6 += input()⟦DEF|v6⟧⟦SRC|Call|input⟧
os.popen(v6)⟦SEC002s|os.popen⟧⟦TAINT001v|os.popen|OS Command Injection⟧⟦SINK|0|os.popen|OS Command Injection⟧⟦SRC|Attribute|os.popen⟧⟦SRC|Call|os.popen⟧
v7 = request.args⟦DEF|v7⟧⟦SRC|Attribute|request.args⟧
cursor.execute("q", v7)⟦TAINT001v|cursor.execute|SQL Injection⟧⟦SINK|0|cursor.execute|SQL Injection⟧
cursor.execute("q", params=v7)⟦TAINT001k|cursor.execute|SQL Injection⟧⟦SINK|0|cursor.execute|SQL Injection⟧
v8 = request.args.get("x")⟦SRC|Attribute|request.args⟧
cursor.execute(v8)⟦SINK|0|cursor.execute|SQL Injection⟧
v9 = request.args["x"]⟦SRC|Attribute|request.args⟧
cursor.execute(v9)⟦SINK|0|cursor.execute|SQL Injection⟧
v10, v11 = input(), 1⟦SRC|Call|input⟧
cursor.execute(v10)⟦SINK|0|cursor.execute|SQL Injection⟧
v12 = [input()]⟦SRC|Call|input⟧
cursor.execute(v12)⟦SINK|0|cursor.execute|SQL Injection⟧
v13 = worker.thread()⟦DEF|v13⟧⟦SRC|Attribute|worker.thread⟧⟦SRC|Call|worker.thread⟧
cursor.execute(v13)⟦TAINT001v|cursor.execute|SQL Injection⟧⟦SINK|0|cursor.execute|SQL Injection⟧
v14 = v7["k"]⟦DEF|v14⟧
cursor.executemany(v14)⟦TAINT001v|cursor.executemany|SQL Injection⟧⟦SINK|0|cursor.executemany|SQL Injection⟧
v15 = str(v14)⟦DEF|v15⟧
log.write(v15, v15)⟦TAINT001v|log.write|Arbitrary File Write⟧⟦SINK|0|log.write|Arbitrary File Write⟧
v16.body = input()⟦DEF|v16.body⟧⟦SRC|Call|input⟧
raw(v16.body.x)⟦TAINT001v|raw|SQL Injection (Django ORM raw query)⟧⟦SINK|0|raw|SQL Injection (Django ORM raw query)⟧
v17 = v18 = input()⟦DEF|v17⟧⟦DEF|v18⟧⟦SRC|Call|input⟧
cursor.execute(v17, more=v18)⟦TAINT001v|cursor.execute|SQL Injection⟧⟦TAINT001k|cursor.execute|SQL Injection⟧⟦SINK|0|cursor.execute|SQL Injection⟧
''',
    # 15: flows inside a function
    '''import os
import subprocess
import sys
def _run(cmd):⟦PYFN|_run|12|2⟧
    os.system(late)⟦SEC002s|os.system⟧⟦SINK|4|os.system|OS Command Injection⟧
    data = open(cmd)⟦DEF|data⟧⟦SRC|Call|open⟧
    subprocess.run(data, shell=True)⟦SEC002h|subprocess.run⟧⟦TAINT001v|subprocess.run|OS Command Injection⟧⟦SINK|4|subprocess.run|OS Command Injection⟧
    lines = open(cmd).read()⟦SRC|Call|open⟧
    subprocess.call(lines)⟦SINK|4|subprocess.call|OS Command Injection⟧
    exec(sys.argv)⟦SEC002e|exec⟧⟦TAINT001v|exec|Code Injection via exec()⟧⟦SINK|4|exec|Code Injection via exec()⟧⟦SRC|Attribute|sys.argv⟧
    compile(source=os.getenv("X"), filename="f", mode="exec")⟦SEC002e|compile⟧⟦TAINT001k|compile|Code Injection via compile()⟧⟦SINK|4|compile|Code Injection via compile()⟧⟦SRC|Attribute|os.getenv⟧⟦SRC|Call|os.getenv⟧
    Template(str(input()))⟦TAINT001v|Template|Server-Side Template Injection⟧⟦SINK|4|Template|Server-Side Template Injection⟧⟦SRC|Call|input⟧
    if cmd:
        late = input()⟦DEF|late⟧⟦SRC|Call|input⟧
    os.system(late)⟦SEC002s|os.system⟧⟦TAINT001v|os.system|OS Command Injection⟧⟦SINK|4|os.system|OS Command Injection⟧
''',
    # 16: does not parse
    '''password = "hunter22"
def broken(:
    eval("x")
''',
    # 17: secrets, TLS, logs
    '''import logging
import ssl
password = "abc"
api_key = 'k1'
SECRET_KEY = "s"
auth_token = "t"
private_key = "p"
db_password = "x"; token = "y"
aws_access_key_id = "AKIA"
password = read_it()
ctx = ssl.CERT_NONE
ssl.PROTOCOL_TLSv1
ssl.PROTOCOL_TLSv1_2
ctx.check_hostname = False
session.get("u", verify = False)
logging.info("password is %s", 1)
logger.debug("Monkey")
print("token", 1)
print("API_KEY", 1)
print("hello")
''',
    # 18: routes; the nearby lines decide
    '''@app.route("/open")
def _open():⟦PYFN|_open|2|1⟧
    return 1








@login_required
@app.get("/in")
def _in():⟦PYFN|_in|3|1⟧

    return 1






@permission_required




@router.post("/five-above")
def _five():⟦PYFN|_five|2|1⟧
    return 1






@jwt_required





@router.put("/six-above")
def _six():⟦PYFN|_six|2|1⟧
    return 1







@blueprint.route("/nine-below")
def _nine():⟦PYFN|_nine|2|1⟧
    return 1






_x = Depends(1)


@app.delete("/ten-below")
def _ten():⟦PYFN|_ten|2|1⟧
    return 1







_x = Depends(2)
''',
    # 19: nothing to report
    '''"""A tidy module."""
# comment

import math


def area(radius: float) -> float:⟦PYFN|area|3|1⟧
    """Area of a circle."""
    return math.pi * radius ** 2
''',
    # 20: empty text
    "",
]

JAVASCRIPT = [
    # security lines
    (".js", '''const express = require('express');
el.innerHTML = name;
el.innerHTML = '';
el.innerHTML='';
el.outerHTML = "" + x;
document.write(x); document.writeln(y);
document.writeln(y);
setTimeout("go()", 10);
setInterval(go, 10);
new Function("return 1");
// eval("x")
  * eval("x")
retrieval(x); eval (x);
const password = "hunter22";
const cfg = { apiKey: "0123456789", token: 'short' };
secretKey = 'abcdefgh1';
private_key: "0123456789abcdef"
Math.random();
obj[_] = 1; obj["__proto__"] = 2;
obj.__proto__ = 3;
Object.assign(Foo.prototype, x);
fs.readFile(req.query.name);
path.join(base, req.params.id);
const p = __dirname + sep + req.query.f;
jwt.verify(t, k, { algorithms: ['none'] });
jwt.decode(t);
jwt.decode(t, { verify: true });
opts = { verify: false, ignoreExpiration: true };
users.find(req.body); users.findOne({ id: 1 });
query = { $where: req.query.w };
app.use(cors());
res.header('Access-Control-Allow-Origin': '*');
origin: '*'
console.log("x");
  debugger;
const re = /(a+)+b/g;
const path2 = "/a/b";
res.redirect(req.query.next);
window.location = targetUrl;
fetch(`http://${host}/x`);
axios(req.url); axios.get("http://x");
'''),
    # smells
    (".jsx", '''import helmet from 'helmet';
import express from "express";
var a = 1;
let variable = 2;
if (a == 2) { b(); }
if (a === 2 || a !== 3 || a <= 4 || a >= 5) { c(); }
// a == b
try { d(); } catch (e) {}
try { d(); } catch (e) {

}
try { d(); } catch (e) { log(e); }
console.info(1); console.warn(2);
p.then(x => x);
p.then(x).catch(y);
p.then(x)
  .catch(y);
delay(3000);
const LIMIT = 5000;
size = 99; rate = 1.2345; id = a12345; n = 0x1234; m = 200;
listen(PORT || 8080);
/* 7777 */
{ { { { {
} } }
// { { { {
{ {
} } } }
'''),
    # functions: 50 and 51 lines, unclosed, one line, long bodies, keywords
    (".ts", "function fifty() {⟦FN|fifty|50|1⟧\n" + "  x();\n" * 48 + "}\n"
     + "const over = (a) => {⟦JSCS001|over|51⟧⟦FN|over|51|1⟧\n" + "  y();\n" * 49 + "}\n"
     + '''function one(a) { if (a) { return a ? 1 : 2; } else if (b && c) { for (;;) {} } }⟦FN|one|8|10⟧
if (x) { y(); }
class K {
  method(a) {⟦FN|method|4|3⟧
    while (a) { a--; }
    try { go(); } catch (e) { stop(); }
  }
}
const fn = async function () {⟦FN|fn|3|2⟧
  return a || b;
}
const obj = { key: function (z) { return z; } };⟦FN|function|3|1⟧
function open_(a) {⟦FN|open_|2|1⟧
  z();
'''),
    # a body longer than the 200 lines that are followed
    (".tsx", "async function huge(a) {⟦JSCS001|huge|205⟧⟦FN|huge|200|1⟧⟦FNW|huge|205|1⟧\n" + "  w();\n" * 203 + "}\n"
     + "const tail = async (b) => b;⟦FN|tail|1|1⟧\n"),
]

SQL = [
    '''SELECT * FROM t;
-- SELECT * FROM hidden;
select  * from u;
SELECT a, b FROM t;
EXEC('drop');
EXECUTE (@q);
-- EXEC('x')
execution (1);
''',
    '''DELETE FROM t;
delete from u where id = 1;
  -- DELETE FROM v;
UPDATE t SET a = 1;
UPDATE t SET a = 1
  WHERE id = 2;
update x set b = 2 where c = 3;
UPDATE y SET d = 4; SELECT 1 WHERE 1 = 1;
-- UPDATE z SET e = 5
''',
    '''BEGIN;
INSERT INTO t VALUES (1);
UPDATE t SET a = 2 WHERE id = 3;
COMMIT;
CREATE USER u WITH PASSWORD = 'pw1';
ALTER LOGIN l SET pwd="x";
''',
    '''INSERT INTO t VALUES (1);
''',
    '''INSERT INTO t VALUES (1);
DELETE FROM t WHERE id = 1;
UPDATE t SET a = 2
''',
]

CSHARP = [
    '''var q = "SELECT * FROM t WHERE id = " + id;
var f = string.Format("DELETE FROM {0}", t);
var i = $"UPDATE {t} SET a = 1";
// var c = "SELECT 1" + x;
var s = "selected " + x;
var password = "p1";
var apiKey = "k"; var token = "t";
connectionString = "server=a;password=b";
var h = MD5.Create();
var d = new SHA1Managed();
var ok = SHA256.Create();
''',
    '''try { a(); } catch (Exception e) {
}
try { a(); }
catch {

}
try { a(); } catch (Exception) { }
try { a(); } catch (Exception e) {
  log(e);
}
Console.WriteLine("x");
Debug.Write("y");
console.write ("z");
Process.Start("cmd");
process.start (x);
var b = new BinaryFormatter();
var c = new binaryformatter();
// new LosFormatter()
catch (E e) {''',
]

_MARK = re.compile("⟦([^⟧]*)⟧")


def templates() -> list[tuple[int, str, str, str, str]]:
    """(template_id, language, suffix, comment mark, text)."""
    rows = [("python", ".py", "#", t) for t in PYTHON]
    rows += [("javascript", s, "//", t) for s, t in JAVASCRIPT]
    rows += [("sql", ".sql", "--", t) for t in SQL]
    rows += [("csharp", ".cs", "//", t) for t in CSHARP]
    return [(i, lang, suffix, mark, _MARK.sub("", text)) for i, (lang, suffix, mark, text) in enumerate(rows)]


def labels() -> list[tuple[int, str, int, str]]:
    """(template_id, rule_id, line, message) for every mark."""
    texts = [*PYTHON, *[t for _, t in JAVASCRIPT], *SQL, *CSHARP]
    out = []
    for i, text in enumerate(texts):
        for n, line in enumerate(text.split("\n"), 1):
            for mark in _MARK.findall(line):
                code, *arguments = mark.split("|")
                out.append((i, code.rstrip("abcdefghijklmnopqrstuvwxyz"), n, EXPECTED[code].format(*arguments)))
    return out


_ASSIGNED = re.compile(r"\s*((?:[A-Za-z_][\w.]* = )+)")
_GROWN = re.compile(r"\s*([A-Za-z_][\w.]*) [-+]= ")


def definitions() -> list[tuple[int, int, str, str]]:
    """(template_id, line, kind, name) of every assignment to names, read off the lines of the Python texts that parse."""
    out = []
    for i, lang, _, _, text in templates():
        if lang != "python" or i in UNPARSABLE:
            continue
        for n, line in enumerate(text.split("\n"), 1):
            for part in line.split("; "):
                if assigned := _ASSIGNED.match(part):
                    out += [(i, n, "assign", name) for name in assigned[1].split(" = ")[:-1]]
                elif grown := _GROWN.match(part):
                    out.append((i, n, "augassign", grown[1]))
    return out


UNPARSABLE = [i for i, text in enumerate(PYTHON) if "def broken(:" in text]
