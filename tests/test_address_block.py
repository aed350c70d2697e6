import ipaddress
import random

from scanforge.streaming.monitor import address_block, block_keys


def plain(ips, cidrs):
    nets = []
    for c in cidrs:
        try:
            nets.append((ipaddress.ip_network(c, strict=False), c))
        except (ValueError, TypeError):
            pass
    out = []
    for ip in ips:
        best = None
        try:
            a = ipaddress.ip_address(ip)
            a = a.ipv4_mapped or a if a.version == 6 else a
            fits = [(-n.prefixlen, c) for n, c in nets if n.version == a.version and a in n]
            best = min(fits)[1] if fits else None
        except (ValueError, TypeError):
            pass
        out.append((ip, best))
    return sorted(out, key=str)


def found(spark, ips, cidrs):
    i = spark.createDataFrame([(x, 1) for x in ips], "ip string, block_no int")
    c = spark.createDataFrame([(x,) for x in cidrs], "cidr string")
    return sorted(((r.ip, r.block) for r in address_block(i, c).collect()), key=str)


def test_random_nested_blocks_of_both_families(spark):
    rng = random.Random(8)
    v4 = [str(ipaddress.ip_address(rng.randrange(1 << 32))) for _ in range(60)]
    v6 = [str(ipaddress.ip_address(rng.randrange(1 << 128))) for _ in range(60)]
    cidrs = [f"{x}/{n}" for x in v4 for n in rng.sample(range(33), 4)] + [f"{x}/{n}" for x in v6 for n in rng.sample(range(129), 5)] + ["0.0.0.0/0", "::/0", "8000::/1"]
    ips = v4 + v6 + [str(ipaddress.ip_address(int(ipaddress.ip_address(x)) ^ (1 << rng.randrange(32)))) for x in v4]
    ips += [str(ipaddress.ip_address(int(ipaddress.ip_address(x)) ^ (1 << rng.randrange(128)))) for x in v6] + ["255.255.255.255", "ffff::", "::"]
    assert found(spark, ips, cidrs) == plain(ips, cidrs)


def test_text_that_is_no_address_or_block(spark):
    ips = ["10.0.0.1", "10.0.0.1", None, "", "x", "10.0.0.256", "::ffff:10.0.0.9", "fd00::1"]
    assert found(spark, ips, ["10.0.0.0/8", "10.0.0.1", "10.0.0.0/33", "bad", None, "1.2.3.4/x", "1.2.3.4/5/6", "fd00::/129"]) == plain(
        ips, ["10.0.0.0/8", "10.0.0.1", "10.0.0.0/33", "bad", None, "fd00::/129"])
    assert found(spark, ips, []) == plain(ips, [])
    assert found(spark, [], ["10.0.0.0/8"]) == []


def test_equal_prefixes_are_one_block(spark):
    c = spark.createDataFrame([("10.1.2.3/8",), ("10.0.0.0/8",), ("::ffff:10.0.0.0/104",)], "cidr string")
    rows = block_keys(c).collect()
    assert [(r._family, r._len, r.block) for r in rows] == [(4, 8, "10.0.0.0/8")]


def test_no_nested_loop_join(spark):
    i, c = spark.createDataFrame([("10.0.0.1",)], "ip string"), spark.createDataFrame([("10.0.0.0/8",)], "cidr string")
    plan = address_block(i, c)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
