"""A small source tree, written for the code-map queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "api/routes.py": '''"""HTTP routes of the shop."""
from fastapi import FastAPI

from services.cart import add_item, total

app = FastAPI()


@app.get("/items/{item_id}")
def read_item(item_id: int) -> dict:
    """Reads an item.

    Args:
        item_id (int): which one

    Returns:
        dict: the item
    """
    amount = total([item_id])
    return {"amount": amount}


@app.post("/items")
def create_item(name: str):
    return add_item(name)
''',
    "services/cart.py": '''"""Cart rules."""
from models.item import Item
from .prices import price_of


def add_item(name: str) -> Item:
    """Adds an item.

    :param name: its name
    :returns: the item
    """
    cost = price_of(name)
    return Item(name=name, cost=cost)


def total(ids):
    result = sum(price_of(str(i)) for i in ids)
    return result
''',
    "services/prices.py": '''import math


def price_of(name):
    return math.ceil(len(name))


def _unused_rate():
    return 1
''',
    "services/__init__.py": "",
    "models/item.py": '''from pydantic import BaseModel


class Owner(BaseModel):
    id: int
    email: str


class Item(BaseModel):
    name: str
    cost: float
    owner_id: int
    owner: Owner
''',
    "tests/test_cart.py": '''from services.cart import add_item


def test_add():
    assert add_item("a")
''',
    "tests/test_prices.py": '''def test_nothing():
    assert True
''',
    "src/index.ts": '''import { helper } from "./util";
import { Hono } from "hono";
import type { Account } from "@/models";

const app = new Hono();
app.use("/api", helper);
app.get("/hello/:name", greet);

export function greet(name: string): string {
  const text = helper(name);
  return text;
}

export async function load() {
  return fetch("/items/7");
}
''',
    "src/util.ts": '''/**
 * Helps.
 * @param {string} value what to help with
 * @returns {string} the help
 */
export function helper(value: string): string {
  return decorate(value);
}

function decorate(value: string): string {
  return value + "!";
}
''',
    "src/models.ts": '''export interface Base {
  id: number;
}

export interface Account extends Base {
  email: string;
  teamId?: number;
}

export const teams = pgTable("teams", {
  id: integer("id"),
  name: text("name"),
});
''',
    "src/lib.rs": '''mod shape;
use crate::shape::area;

pub fn run(x: f64) -> f64 {
    let y = area(x);
    y
}
''',
    "src/shape.rs": '''pub fn area(x: f64) -> f64 {
    x * x
}
''',
    "schema.sql": '''CREATE TABLE orders (
  id INTEGER PRIMARY KEY,
  item_id INTEGER,
  note TEXT
);
''',
    "examples/demo.py": 'from fastapi import FastAPI\n\napp = FastAPI()\n',
    "docs/cart.md": "# Cart\n",
    "package.json": '{"name": "shop", "main": "src/index.ts", "dependencies": {"hono": "4"}}',
}

ALIASES = [("@/*", "src/*", ".")]


def files(spark: SparkSession) -> DataFrame:
    """(path, content)."""
    return spark.createDataFrame(sorted(FILES.items()), "path string, content string")
