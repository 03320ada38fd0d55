"""Targets with subscripts, literals in containers and calls, block scalars, sums of constants: what is bound, what is not, in linear time."""

import time

import pytest

from cairnfield.llm import secrets

A, B = "xK9f7Qz2LmP8rT4w", "aB3dE5gH7jK9"


def bound(text):
    return [text[lo:hi] for lo, k, hi in secrets.spans(text)[1] if k == 3]


@pytest.mark.parametrize(
    "text,want",
    [
        (f'config["db_pwd"] = "{A}"', [A]), (f"os.environ['SIGNING_KEY'] = '{A}'", [A]), (f'cfg["a"]["db_pwd"] = "{A}"', [A]), (f'config["db_password"] = "{A}"', [A]),
        (f'private_key = ["{A}"]', [A]), (f'secrets = {{"a": "{A}", "b": "{B}"}}', [A, B]), (f'api_tokens = ["{A}", "{B}"]', [A, B]), (f'pwd = ("{A}")', [A]),
        (f"client_secret: |\n  {A}\nname: x", [A]), (f"a:\n  client_secret: >-\n    {A}\n    {B}\n  b: 1", [f"{A}\n    {B}"]), (f"credentials:\n  main: {A}\n  user: {B}", [A]),
        (f'A = "{A}"; B = "{B}"; db_secret_value = A + B', [A, B]), (f'A = "{A}"\npwd = "{B}" + A', [A, B]), ('A = "xK9f7"; B = "z2LmP8"\npwd = A + B', ["xK9f7", "z2LmP8"]),
        (f'pwd = A + B\nA = "{A}"\nB = "{B}"', [A, B]), (f'bearer = os.getenv("T", "{A}")', [A]), (f'signing_key = base64.b64decode("{A}")', [A]), (f'k = decode("{A}")\npwd = k', [A]),
        (f'k = "{A}"\npwd = decode(strip(k), 1)', [A]), (f'pwd = "{A}".encode("utf-8")', [A]), (f'x = Client(user="bob", pwd="{A}")', [A]), (f'pwd: str = "{A}"', [A]),
    ],
)
def test_bound(text, want):
    assert bound(text) == want


@pytest.mark.parametrize(
    "text",
    [
        'pwd = os.getenv("DB_PASSWORD_PROD2")', 'secrets = {"user": "Bob2Smith9xQ"}', 'pwd = t("Enter 8 digits here")', 'tokens = ["alpha", "beta", "gamma-delta"]', f'x = {{"secret": {{}}, "a": "{A}"}}',
        f'a = "{A}"; n_pwd = len(b) + 1', "pwd:\n  |\n", f"note: |\n  {A}\n", 'signing_key = open("/etc/keys/a1/k.pem")', "password: |\n", f'pwd = x\ny = "{A}"', "credentials:\n  host: db1.example.org\n  path: /srv/a1",
    ],
)
def test_not_bound(text):
    assert bound(text) == []


@pytest.mark.parametrize("unit", ["a=f(b=", "a=[", "pwd: |\n ", "pwd = a + ", "a = a + a\n", 'a = a + "x1"\n', "a = f(a)\n", "a = (", "x.y(", 'a["b"]=', "secret={", "a=new ", "a=b+\n"])
def test_linear(unit):
    took = []
    for n in (20_000, 200_000):
        text = "pwd = " + unit * (n // len(unit))
        begun = time.process_time()
        secrets.bound_spans(text)
        took.append(time.process_time() - begun)
    assert took[1] < 30 * took[0] + 0.5
