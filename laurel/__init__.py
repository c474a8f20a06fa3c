"""laurel: contest-history analytics as Spark DataFrame plans.

A *contest* is one (category, period); its *nominees* compete and one or more
of them win.  Every public function takes DataFrames and returns a lazy
DataFrame, so Catalyst plans the whole pipeline at once.
"""
