"""A small source tree of our own, and the rows that each kind of extraction is to find in it, written by hand."""

from __future__ import annotations

PYTHON = '''import os, json as j
from .models import Order
from app.core import pay
import logging

logger = logging.getLogger(__name__)


@dataclass
class Order(Base, abc.Thing):
    id: int
    note: str = "none"


class Shop:
    async def sell(self, item: str, count=1, *rest, price: float = 2.5, **more) -> bool:
        try:
            for x in rest:
                if x:
                    logger.warning(f"odd {x} in {item!r}")
            logger.info("sold " + item + " now")
        except KeyError:
            self.log.exception("no " "item")
        return pay(item)


def run(order):
    logger.error("failed %s", order)
    check(order.total())
    logging.debug(order)


logger.critical("loaded")
'''

GO = '''package main

import (
	"fmt"
	log "github.com/x/zerolog"
)

type Server struct {
	Name, Host string `json:"name"`
	*Pool
	Port int
}

func (s *Server) Handle(ctx Context, a, b int) (bool, error) {
	if a > b {
		log.Error().Err(err).Msg("bad " + ctx.ID + " value %d")
	}
	for i := 0; i < a; i++ {
		s.logger.Infof("step %d of %s", i, b)
		switch i {
		case 1:
			slog.Warn("one", zap.Error(err))
		}
	}
	defer func() {
		fmt.Println(`done %v`)
	}()
	http.Error(w, "no", 400)
	s.save(a)
	return true, nil
}

func main() {
	go func() {
		logger.Fatal(fmt.Sprintf("dead %s", x))
	}()
	work := func() {
		start(1)
	}
	work()
	log.Info().Send()
}
'''

TS = '''import { A } from "./a";
import b from 'lib/b';
const c = require("c");

interface Item extends Base, Other {
  id: number;
  name?: string;
  tags: string[];
}

type Point = { x: number, y };

@Injectable()
export class Cart {
  @Log("x")
  async add(item: Item, count = 1): Promise<void> {
    try {
      if (count > 1) {
        console.log(`added ${item.name} x ${count}`);
      }
      for (const t of item.tags) { this.logger.debug("tag " + t); }
    } catch (e) {
      logger.error("failed", e);
    }
    this.save(item);
  }
}

const load = async (id: string) => {
  switch (id) {
    case "a":
      logger.warn('case a');
  }
  items.forEach(x => { logger.trace(id); fetchAll(x); });
  return new Loader(id);
};

function main(): void {
  load("a");
}
logger.info("top");
'''

FILES = (("src/app/shop.py", "python", PYTHON), ("svc/server.go", "go", GO), ("web/src/cart.ts", "typescript", TS))

#: line, level, function, class, template
SITES = {
    "python": (
        (20, "warning", "sell", "Shop", "odd {} in {}"),
        (21, "info", "sell", "Shop", "sold {} now"),
        (23, "exception", "sell", "Shop", "{}"),
        (28, "error", "run", None, "failed %s"),
        (30, "debug", "run", None, "{}"),
        (33, "critical", "<module>", None, "loaded"),
    ),
    "go": (
        (16, "error", "Server.Handle", None, "bad {} value {}"),
        (19, "info", "Server.Handle", None, "step {} of {}"),
        (22, "warning", "Server.Handle", None, "one"),
        (26, "info", "Server.Handle", None, "done {}"),
        (35, "critical", "main", None, "dead {}"),
        (41, "info", "main", None, "(zerolog.Send)"),
    ),
    "typescript": (
        (19, "info", "Cart.add", "Cart", "added {} x {}"),
        (21, "debug", "Cart.add", "Cart", "tag {}"),
        (23, "error", "Cart.add", "Cart", "failed"),
        (32, "warning", "load", None, "case a"),
        (34, "debug", "load", None, "{}"),
        (41, "info", "<module>", None, "top"),
    ),
}
#: line, flags that are set, parameters, result
CONTEXTS = {
    "python": (
        (20, "in_if_block,in_loop,in_try_except,sig_async", "item:str,count=1,*rest,price:float=2.5,**more", "bool"),
        (21, "in_try_except,sig_async", "item:str,count=1,*rest,price:float=2.5,**more", "bool"),
        (23, "in_try_except,sig_async", "item:str,count=1,*rest,price:float=2.5,**more", "bool"),
        (28, "", "order", None),
        (30, "", "order", None),
        (33, "", None, None),
    ),
    "go": (
        (16, "in_if_block", "ctx:Context,a:int,b:int", "(bool, error)"),
        (19, "in_loop", "ctx:Context,a:int,b:int", "(bool, error)"),
        (22, "in_loop,in_switch", "ctx:Context,a:int,b:int", "(bool, error)"),
        (26, "in_closure,in_defer", "ctx:Context,a:int,b:int", "(bool, error)"),
        (35, "in_closure,in_goroutine", "", None),
        (41, "", "", None),
    ),
    "typescript": (
        (19, "in_if_block,in_try_except,is_async,sig_async", "item:Item,count", "Promise<void>"),
        (21, "in_loop,in_try_except,is_async,sig_async", "item:Item,count", "Promise<void>"),
        (23, "in_catch,in_try_except,is_async,sig_async", "item:Item,count", "Promise<void>"),
        (32, "in_switch,is_async,sig_async", "id:string", None),
        (34, "is_async,sig_async", "id:string", None),
        (41, "", None, None),
    ),
}
MODELS = {
    "python": (("Order", 10, "Base,abc.Thing", 'id:int,note:str="none"'),),
    "go": (("Server", 8, "", 'Name:string=json:"name",Host:string=json:"name",Pool:*Pool,Port:int'),),
    "typescript": (("Item", 5, "Base,Other", "id:number,name:string (optional),tags:string[]"), ("Point", 11, "", "x:number,y:any")),
}
IMPORTS = {
    "python": (".models", "app.core", "json", "logging", "os"),
    "go": ("fmt", "github.com/x/zerolog"),
    "typescript": ("'lib/b'", "./a", "c"),
}
FUNCTIONS = {"python": ("run", "sell"), "go": ("Server.Handle", "main"), "typescript": ("Cart.add", "load", "main")}
CALLS = {
    "python": (("Shop.sell", "pay"), ("run", "check"), ("run", "total")),
    "go": (("Server.Handle", "Err"), ("Server.Handle", "Msg"), ("Server.Handle", "save"), ("main", "Send"), ("main", "start"), ("main", "work")),
    "typescript": (("Cart.add", "save"), ("load", "Loader"), ("load", "fetchAll"), ("main", "load")),
}
MODULES = {"python": "app.shop", "go": "svc/server", "typescript": "src/cart"}
#: line, level, template found by the text pattern alone
TEXT_SITES = ((20, "warning", "odd {x} in {item!r}"), (21, "info", "sold "), (23, "exception", "no "), (28, "error", "failed %s"), (33, "critical", "loaded"))
