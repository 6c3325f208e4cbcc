import pytest
import yaml

from riskweave.sources import manifests, yamltext


def test_fast_and_alike(monkeypatch):
    texts = ["", "rules:\n- id: a\n  languages: [python]\n", "a: &x {b: 1}\nc: *x\n", "d: 2020-01-01\ne: 0o7\nf: 1_000\ng: yes\nh: ~\n", "w: " + "x" * 900 + "\nl: [1, [2]]\n"]
    want = [yaml.safe_load(t) for t in texts]
    monkeypatch.setattr(yaml, "safe_load", None)
    assert [yamltext.load(t) for t in texts] == want


@pytest.mark.parametrize("text", ["[" * 100_000, "- " * 100_000 + "a", "a: [\n", "packages:\n" + "".join(" " * i + "k:\n" for i in range(1, 3000))])
def test_deep_and_broken(text):
    assert manifests.parse("m/pubspec.lock", text) == []
    with pytest.raises((yaml.YAMLError, RecursionError)):
        yamltext.load(text)
