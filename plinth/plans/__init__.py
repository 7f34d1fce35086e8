"""Query catalogue and plan builders."""
