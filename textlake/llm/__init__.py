"""Training-data operators. One module per operator; ``registry`` has their queries and SQL.

Nothing outside this subpackage imports it. General helpers (session, scratch tables) come from ``textlake``.
"""
