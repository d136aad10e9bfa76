"""Query catalogue: one module per section of the operator inventory.

Stand-in conventions (the driver tables replace the analysed datasets):

* series = ``events`` per (``user_id``, ``event_type``) ordered by (``ts``, ``event_id``);
  device = ``user_id``, lane = ``event_type``, traffic = ``value``;
* "gapped value" = ``CASE WHEN value > 10 THEN value END`` -- the driver tables carry no
  nulls, so null handling is exercised on this deterministic rule;
* passengers = ``orders`` (joined to ``customer`` where attributes are needed);
* money is summed as ``decimal(18,2)`` and ratios are rounded to 6 places so that Spark
  and the oracle agree bit for bit.
"""
