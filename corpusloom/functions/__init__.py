from . import commands, imports, names, paths, secrets, text, traces

__all__ = ["commands", "imports", "names", "paths", "secrets", "text", "traces"]
