"""Every secret rule finds with its cheap pre-check what its plain pattern finds."""

import pytest

from plumbline.llm import secrets

SAMPLES = {
    "pem": ["-----BEGIN PRIVATE KEY-----\nMIIB\n", "-----BEGIN EC PRIVATE KEY-----\nAb+/=\n-----END EC PRIVATE KEY-----"],
    "jwt": ["eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12],
    "vendor": [f"gh{c}_" + "A1" * 20 for c in "pousr"] + [f"xox{c}-" + "1a-" * 8 for c in "abprs"] + ["sk_live_" + "Z9" * 10],
    "login": ["ftp://me:pass1@host", "https://" + "u" * 90 + ":" + "p" * 300 + "@host.example"],
}


@pytest.mark.parametrize("kind", secrets.MORE_RULES)
def test_rule_equals_its_pattern(kind):
    plain = "some words without any of it"
    for sample in [plain, *SAMPLES[kind]]:
        for text in (sample, f"{plain} {sample} {plain}", f"under_score {sample}", f"{sample}\n{sample}"):
            found = [s for s in secrets.find_spans(text) if s[0] == kind]
            assert found == [(kind, *m.span()) for m in secrets.MORE_RULES[kind].finditer(text)]
            assert len(found) == (text.count(sample) if sample != plain else 0)


def test_long_logins_are_whole():
    text = "https://" + "u" * 90 + ":" + "p" * 300 + "@host.example"
    assert secrets.find_spans(text) == [("login", 0, len(text))]
