"""Rules over files of events to alert rows: what the command line does."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ruleforge.operators.correlate import CorrelationError, correlate, resolve
from ruleforge.operators.detect import Bundle, is_stateful
from ruleforge.operators.options import Options
from ruleforge.operators.route import channels_of, in_channel
from ruleforge.rules.model import Rule
from ruleforge.rules.timespan import parse_timeframe
from ruleforge.sources.alerts import alerts, write_csv
from ruleforge.sources.flatten import event_time
from ruleforge.sources.records import read_records
from ruleforge.sources.rules import exclude_rules, load_configs, load_exclusions, load_rules

log = logging.getLogger(__name__)


def find_alerts(events: DataFrame, rules: list[Rule], options: Options | None = None, channel_filter: bool = True) -> DataFrame:
    """Alert rows of all rules and correlations over flat events.

    The channel filter applies ahead of rules without state and after those with state, whose windows see every
    channel; correlations aren't filtered. Correlations that can't be built are warned of and left out.
    """
    options = options or Options()
    columns = events.columns
    if options.time not in columns:
        events = events.withColumn("_time", F.coalesce(event_time(events), F.current_timestamp()))
        options = Options(**(options.__dict__ | {"time": "_time", "seq": options.seq or ("_record" if "_record" in columns else None)}))
    plain = [r for r in rules if r.correlation is None]
    filters: dict[str, Column] = {r.key: in_channel(r, F.col("Channel")) for r in plain if channel_filter and "Channel" in columns and channels_of(r.logsource)}
    bundle = Bundle(plain, options)
    found = bundle.detect(events, before={k: c for k, c in filters.items() if not is_stateful(next(r for r in plain if r.key == k))}, after={k: c for k, c in filters.items() if is_stateful(next(r for r in plain if r.key == k))})
    for key, why in bundle.skipped_rules.items():
        log.warning("rule %s is left out: %s", key, why)
    for r in rules:
        if r.correlation is None:
            continue
        try:
            resolve(r, rules)
        except CorrelationError as e:
            log.warning("correlation left out: %s", e)
            continue
        found = found.unionByName(correlate(events, r, rules, options).drop("group_values"))
    return alerts(found, rules, ignore=("_time",))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ruleforge", description="Applies detection rules to files of events and writes alerts as CSV.")
    parser.add_argument("inputs", nargs="+", help="files or folders of events")
    parser.add_argument("-rules", "--rules", required=True, help="rule file, or folder of .yml and .yaml files")
    parser.add_argument("-config", "--config", action="append", default=[], help="configuration, may be given several times")
    parser.add_argument("-out", "--out", help="folder for the CSV; without it alerts are printed")
    parser.add_argument("-timeframe", "--timeframe", default="1h", help="window of aggregates whose rule has no timeframe")
    parser.add_argument("-channel-filter", "--channel-filter", default="true", choices=["true", "false"], help="apply rules only to the channels of their log source")
    parser.add_argument("-exclude", "--exclude", default="", help="comma-separated files of rule ids to leave out")
    parser.add_argument("-format", "--format", default="json", help="format of the events")
    args = parser.parse_args(argv)
    rules = load_rules(args.rules)
    if args.exclude:
        rules = exclude_rules(rules, load_exclusions(args.exclude))
    spark = SparkSession.builder.getOrCreate()
    counted, matched = Observation("scanned"), Observation("matched")
    events = read_records(spark, args.inputs, args.format).observe(counted, F.count(F.lit(1)).alias("n"))
    rows = find_alerts(events, rules, Options(configs=load_configs(args.config), window=parse_timeframe(args.timeframe)), args.channel_filter == "true").observe(matched, F.count(F.lit(1)).alias("n"))
    if args.out:
        write_csv(rows, args.out)
    else:
        print(rows.toPandas().to_csv(index=False), end="")
    print(f"scanned {counted.get['n']} events with {len(rules)} rules, {matched.get['n']} alerts", file=sys.stderr)
    return 0
