"""YAML by libyaml, where it is there and can."""

from __future__ import annotations

#: libyaml's loader descends without a limit, so what may be nested deeper than this is left to the slow parser,
#: which gives up by an exception.
DEEPEST = 200


def _shallow(text: str) -> bool:
    """Is nothing nested deep? Blocks begin in later columns than what they are in, flows with a bracket; where
    that does not tell, the events do."""
    import yaml

    if text.count("[") + text.count("{") <= DEEPEST and max(map(len, text.split("\n"))) <= DEEPEST:
        return True
    depth = 0
    for e in yaml.parse(text, Loader=yaml.CSafeLoader):
        if isinstance(e, yaml.CollectionStartEvent):
            depth += 1
            if depth > DEEPEST:
                return False
        elif isinstance(e, yaml.CollectionEndEvent):
            depth -= 1
    return True


def load(text: str):
    """What ``yaml.safe_load`` gives, in a part of its time. What libyaml does not take is read, or refused, by
    the slow parser."""
    import yaml

    if not hasattr(yaml, "CSafeLoader"):
        return yaml.safe_load(text)
    try:
        if _shallow(text):
            return yaml.load(text, Loader=yaml.CSafeLoader)  # noqa: S506
    except yaml.YAMLError:
        pass
    return yaml.safe_load(text)
